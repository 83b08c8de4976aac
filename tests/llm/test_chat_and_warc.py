import base64
import gzip
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from factloom.llm import chat_format, warc_writer

from . import cases

TRICKY = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/INST] x", "<<SYS>>", "<<\\/SYS>><s>", "[ROLE] a [/ROLE]", "<|endoftext|>", "é\n\n漢 字", "", None, "<<s>", "\\", "[[INST]]"]


@pytest.mark.parametrize("text", [t for t in TRICKY if t])
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat_format.escape(text)
    assert chat_format.unescape(escaped) == text
    assert not any(c in escaped for c in chat_format.CONTROL)


def conversations(spark, rows):
    schema = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType()),
                         *(StructField(c, StringType()) for c in ("start", "ids", "mask", "place", "n", "inside", "local", "_conv"))])
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], schema)


def expected(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = []
    for conv, turns in by.items():
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_chat_round_trip(spark):
    rows = [(i % 5, i, ("user", "assistant", "system", "tool", None)[i % 5 if i % 3 else 1], TRICKY[i % len(TRICKY)]) for i in range(60)]
    rows += [(9, None, "user", "first"), (9, 1, "assistant", "b"), (9, 1, "assistant", "a"), (9, 1, "assistant", "a"), (None, 1, "user", "no id"), (None, 2, "assistant", "still none")]
    rows += [(77, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(3000)] + [(78, 0, "assistant", "long " * 20_000), (79, 0, "[ROLE]", "odd role")]
    turns = chat_format.formatted_turns(conversations(spark, rows).repartition(6))
    assert cases.pairs(chat_format.read_back(turns), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == expected(rows)
    # places follow on each other across blocks of turns
    at = 0
    for r in sorted(turns.where("conv_id = 77").collect(), key=lambda r: r.place):
        assert r.start == at
        at += len(r.mask)
    assert at > 0 and turns.where("conv_id = 77").count() == 3000


def test_mask_covers_assistant_texts_only(spark):
    turns = chat_format.formatted_turns(conversations(spark, [(1, 0, "user", "question"), (1, 1, "assistant", "the answer")]))
    coder = chat_format.encoding(chat_format.tokenizer_path())
    rows = sorted(turns.collect(), key=lambda r: r.place)
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows])
    mask = np.concatenate([np.frombuffer(r.mask, np.uint8) for r in rows])
    assert coder.decode(ids.tolist()) == "<s>[INST]question[/INST]the answer</s>" and coder.decode(ids[mask > 0].tolist()) == "the answer"


def test_chat_of_no_rows(spark):
    assert chat_format.read_back(chat_format.formatted_turns(conversations(spark, []))).collect() == []


def pages(spark, rows):
    schema = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType()),
                         *(StructField(c, StringType()) for c in ("shard", "payload", "size", "content", "n", "response_id", "bucket"))])
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], schema)


def page_rows():
    long, odd = "<p>words</p>" * 200, "é漢\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(i, f"http://h/{i}", f"page {i} " * (i % 40)) for i in range(300)]
    rows += [(1000 + i, "http://h/same", long) for i in range(150)] + [(2000, None, odd), (2001, "http://h/a b\r\nX: y", odd), (2002, "", None), (2003, "u", ""), (2004, "u", "x" * 999), (2005, "u", "x" * 999)]
    return rows + [(2006, "u", "y" * 1000), (2007, "u", "y" * 1000), (2008, "big", "z" * 3_000_000), (10 ** 12, "far", "far away")]


def expected_pages(rows):
    keep = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            keep[h] = max(i, keep.get(h, i))
    out = []
    for i, _, h in rows:
        data, other = (h or "").encode(), keep.get(h, i)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if other == i else "revisit", None if other == i else other))
    return sorted(out, key=repr)


def test_archives_round_trip_and_are_deterministic(spark, tmp_path):
    rows, digests = page_rows(), []
    for name, parts in (("a", 3), ("b", 7)):
        folder = (tmp_path / name).as_uri()
        manifest = warc_writer.write_archives(pages(spark, rows).repartition(parts), folder, shard_bytes=60_000, roll_bytes=4_000)
        found = warc_writer.read_archives(manifest)
        assert cases.pairs(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected_pages(rows)
        files = {r.name: r for r in manifest.collect()}
        assert len(files) > 8 and set(files) == {f for f in os.listdir(tmp_path / name) if f.endswith(".warc.gz")}
        for f, r in files.items():
            data = (tmp_path / name / f).read_bytes()
            assert hashlib.sha256(data).hexdigest() == r.sha256 and len(data) == r.bytes
            assert r.bytes <= 4_000 or r.records == 1 or r.bytes < 5_000
        digests.append({f: r.sha256 for f, r in files.items()})
        assert os.listdir(tmp_path / name / "attempts") == [] or all(x.startswith(".") for x in os.listdir(tmp_path / name / "attempts"))
    assert digests[0] == digests[1]


def test_records_are_sorted_and_well_formed(spark, tmp_path):
    manifest = warc_writer.write_archives(pages(spark, page_rows()[:40]), tmp_path.as_uri())
    assert manifest.count() == 1
    data = gzip.decompress((tmp_path / manifest.first().name).read_bytes())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and data.count(b"WARC-Type: response") == 40
    found = warc_writer.read_archives(manifest).collect()
    assert [r.page_id for r in sorted(found, key=lambda r: r.offset)] == list(range(40))


def test_damage_is_noticed(spark, tmp_path):
    manifest = warc_writer.write_archives(pages(spark, [(1, "u", "some text")]), tmp_path.as_uri())
    path = tmp_path / manifest.first().name
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"some text", b"sOme text")))
    with pytest.raises(Exception, match="digest"):
        warc_writer.read_archives(manifest).collect()


def test_pages_without_ids_repeated_pages_and_no_pages(spark):
    body = "b" * 1500
    rows = [(None, "u", body), (None, "u", "short"), (5, "u", body), (5, "u", body)]
    found = warc_writer.read_archives(warc_writer.write_archives(pages(spark, rows)))
    assert cases.pairs(found, "page_id", "record_type", "refers_to") == sorted([(None, "revisit", 5), (None, "response", None), (5, "response", None), (5, "response", None)], key=repr)
    assert warc_writer.read_archives(warc_writer.write_archives(pages(spark, []))).collect() == []


def test_base32_and_hex_digests_agree():
    assert base64.b32decode(warc_writer._digest(b"x")[5:]).hex() == hashlib.sha1(b"x").hexdigest()
