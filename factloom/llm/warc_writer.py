"""WARC archives from pages: a deterministic sharded writer and a reader.

Writing. Equal payloads (SHA-256 and length, counted with partial aggregation) of some size are stored once; the others
refer to it. Records are sorted by page id and cut into shards at exact weights: running sums over the ids give the same
cuts for the same pages on any cluster (sampled splitters would not). Every shard is sorted by Spark's spilling sort and
streamed by one task, record by record; files roll when their compressed size is reached. Headers, record ids and digests
are made anew from the content, dates are a parameter and gzip members carry no time, so the bytes only depend on the
pages and the parameters. Payloads of revisits are not moved.

Committing. A task writes under a name of its own attempt. Spark's committed manifest names the files of successful
attempts only; these are renamed to their final names, which can be repeated, and then the final manifest is written.
Readers open what a manifest names and check every digest.

The folder must be one that executors reach through ``pyarrow.fs`` (a shared mount, HDFS, an object store).

Edge cases: a null html is an empty payload; a null or odd URL is replaced by ``urn:page:<id>`` or percent-encoded; a
null id sorts first and is no one's reference while others exist; rows of one id with equal payloads are all responses;
other columns are not read; no pages give a manifest without files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import small
from .common import new_folder, query, stored, table

REVISIT_BYTES = 1000
SHARD_BYTES = 1 << 26  # payload bytes of a shard, about
ROLL_BYTES = 1 << 24  # compressed bytes after which a file is closed
LISTED_GROUPS = 100_000  # groups of equal payloads (48 bytes each) that may be broadcast; more are joined by shuffle
RECORD_BYTES = 600  # of headers, counted for the shards' weights
DATE = "2024-01-01T00:00:00Z"
READERS = 100_000  # tasks that read archives
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MANIFEST = "shard long, sequence int, attempt string, name string, records long, bytes long, sha256 string"


def page_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, size, record_type, refers_to``: of equal payloads of at least ``least`` bytes the largest id is the response."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "content": F.unhex(F.sha2("payload", 256))})
    groups = stored(rows.where(F.col("size") >= least).groupBy("content", "size").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select("content", "size", "response_id"), "equal-payloads")
    joined = rows.join(small(groups, LISTED_GROUPS), ["content", "size"], "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return joined.select("page_id", "url", "payload", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("response_id")).alias("refers_to"))


def sharded(records: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """Adds ``shard``: consecutive id ranges of about ``shard_bytes`` each; and the number of shards.

    A shard is the running sum of all weights before an id, divided by its size: the same on any cluster. The sum runs inside
    the partitions of a range exchange of (id, weight), after the partitions' totals; only the shards' first ids are kept.
    """
    weight = F.sum(F.when(F.col("record_type") == "response", F.col("size")).otherwise(0) + RECORD_BYTES)
    sizes = stored(records.where("page_id is not null").groupBy("page_id").agg(weight.alias("bytes")), "page-weights")

    def run(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            upto = before + np.cumsum(batch.column(1).to_numpy())
            yield pa.record_batch([batch.column(0), pa.array(upto - batch.column(1).to_numpy()), batch.column(1), pa.array(np.full(len(upto), part, np.int32))],
                                  names=["page_id", "inside", "bytes", "part"])
            before = int(upto[-1]) if len(upto) else before

    ordered = sizes.repartitionByRange("page_id").sortWithinPartitions("page_id").select("page_id", "bytes")
    placed = stored(ordered.mapInArrow(run, "page_id long, inside long, bytes long, part int"), "page-places")
    totals = placed.groupBy("part").agg(F.sum("bytes").alias("total"))  # one row per partition of the exchange
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.join(F.broadcast(totals.select("part", before.alias("before"))), "part").withColumn("shard", F.expr(f"(before + inside) div {shard_bytes}"))
    firsts = numbered.groupBy("shard").agg(F.min("page_id").alias("first")).select("first").collect()  # a row per shard, 8 bytes for 64 MB
    cuts = np.sort(np.array([r["first"] for r in firsts], np.int64))[1:]
    known = records.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("long")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(known.value, ids.to_numpy(), side="right"))

    # null ids sort first
    return records.withColumn("shard", shard(F.coalesce("page_id", F.lit(-(1 << 63))))), len(cuts) + 1


def _identity(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _target(url: str | None, page_id) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")


def record_bytes(page_id, url, payload: bytes | None, record_type: str, refers_to, date: str = DATE, sha1: bytes | None = None, size: int | None = None) -> bytes:
    """One record with headers and digests made from its content; of a revisit the payload's SHA-1 and size are enough."""
    digest = _digest(payload) if payload is not None else "sha1:" + base64.b32encode(sha1).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size if payload is None else len(payload)}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_identity(page_id, digest)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {_target(url, page_id)}", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_digest(block)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if record_type == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_identity(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = b"software: factloom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'file:' + name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}",
            f"WARC-Block-Digest: {_digest(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least: int = REVISIT_BYTES,
                   date: str = DATE, level: int = 6) -> DataFrame:
    """Archives ``<folder>/warc-<shard>-<sequence>.warc.gz`` and the manifest ``<folder>/manifest``; returns the manifest."""
    folder = folder or new_folder(pages.sparkSession, "warc")

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/attempts", recursive=True)
        attempt, stream, now = uuid.uuid4().hex, None, None
        size = records = sequence = 0
        check = None

        def put(data: bytes) -> None:
            nonlocal size
            stream.write(data)
            check.update(data)
            size += len(data)

        def closed():
            stream.close()
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([sequence], pa.int32()), pa.array([attempt]), pa.array([name]), pa.array([records], pa.int64()),
                                    pa.array([size], pa.int64()), pa.array([check.hexdigest()])], names=["shard", "sequence", "attempt", "name", "records", "bytes", "sha256"])

        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                shard, page, url, kind, other, payload, sha1, full = (at[c][i].as_py() for c in ("shard", "page_id", "url", "record_type", "refers_to", "payload", "sha1", "size"))
                data = _member(record_bytes(page, url, payload, kind, other, date, sha1, full), level)
                if stream is not None and (shard != now or size + len(data) > roll_bytes):
                    yield closed()
                    stream, sequence = None, sequence + 1 if shard == now else 0
                if stream is None:
                    now, size, records, check = shard, 0, 0, hashlib.sha256()
                    name = f"warc-{shard:06d}-{sequence:04d}.warc.gz"
                    stream = store.open_output_stream(f"{root}/attempts/{attempt}-{name}", compression=None)
                    put(_member(_info(name, date), level))
                put(data)
                records += 1
        if stream is not None:
            yield closed()

    def commit(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            at = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for attempt, name, size in zip(at["attempt"], at["name"], at["bytes"]):
                source, target = f"{root}/attempts/{attempt}-{name}", f"{root}/{name}"
                if store.get_file_info(source).type != fs.FileType.NotFound:
                    store.move(source, target)
                if store.get_file_info(target).size != size:  # a commit that is run again finds the file in place
                    raise OSError(f"{target} is not what was written")
            yield batch

    dealt, shards = sharded(page_records(pages, least), shard_bytes)
    # a task for every shard, none for two
    revisit = F.col("record_type") == "revisit"  # their payloads are not moved
    placed = dealt.select("shard", "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "record_type", "refers_to", "size",
                          F.when(revisit, F.unhex(F.sha1("payload"))).alias("sha1")).repartitionById(shards, F.col("shard").cast("int"))
    ordered = placed.sortWithinPartitions(F.col("shard"), F.col("page_id").asc_nulls_first(), "record_type", "url")
    written = stored(ordered.mapInArrow(write, _MANIFEST), "warc-attempts")
    # files are renamed in parallel, one row each; the manifest comes last
    renamed = stored(written.repartition(max(1, min(READERS, shards)), "name").mapInArrow(commit, _MANIFEST), "warc-committed")
    renamed.drop("attempt").coalesce(1).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest").withColumn("folder", F.lit(folder))


def _header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {a.lower(): b.strip() for a, _, b in (x.partition(":") for x in lines[1:])}


def _members(source, chunk: int = 1 << 18):
    """(offset, length, record) of every gzip member of a file, one record in memory at a time."""
    offset, rest, ended = 0, b"", False
    while True:
        unpack, parts, read = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            data = rest or source.read(chunk)
            rest = b""
            if not data:
                if read:
                    raise ValueError("the archive ends inside a record")
                ended = True
                break
            read += len(data)
            parts.append(unpack.decompress(data))
        if ended:
            return
        rest = unpack.unused_data
        length = read - len(rest)
        yield offset, length, b"".join(parts)
        offset += length


def _records(source, name: str):
    """(offset, length, header fields, block) of every record; a gzip member may hold several."""
    for offset, length, member in _members(source):
        while member:
            head, _, rest = member.partition(b"\r\n\r\n")
            fields = _header(head)
            n = int(fields.get("content-length", -1))
            if not head.startswith(b"WARC/") or n < 0 or rest[n:n + 4] != b"\r\n\r\n":
                raise ValueError(f"{name}: no record at {offset}")
            member = rest[n + 4:]
            yield offset, length, fields, rest[:n]


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the files a manifest names, every digest checked: ``page_id, payload_bytes, payload_digest, record_type, refers_to,
    url, file, offset, length``. ``payload_digest`` is the bare lower-case hex SHA-1."""
    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for folder, name in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                store, root = fs.FileSystem.from_uri(folder)
                rows = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for offset, length, fields, block in _records(source, name):
                        kind = fields["warc-type"]
                        if _digest(block) != fields["warc-block-digest"]:
                            raise ValueError(f"{name}: block digest at {offset}")
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
                        if kind == "response" and (len(payload) != size or _digest(payload) != fields["warc-payload-digest"]):
                            raise ValueError(f"{name}: payload digest at {offset}")
                        page, other = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                        rows.append((None if page is None else int(page), size, base64.b32decode(fields["warc-payload-digest"][5:]).hex(), kind,
                                     None if other is None else int(other), fields["warc-target-uri"], name, offset, length))
                        if len(rows) >= 4096:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    # a task for every file, however small the rows that name them
    n = max(1, min(READERS, manifest.count()))
    place = F.row_number().over(Window.partitionBy("part").orderBy("folder", "name"))  # even, and the names of a part are few
    files = manifest.select("folder", "name", F.pmod(F.xxhash64("name"), F.lit(-(-n // 1000))).alias("part")).withColumn("place", place)
    dealt = files.repartitionById(n, F.pmod(F.col("place") + F.hash("part").cast("long"), F.lit(n)).cast("int"))
    return dealt.select("folder", "name").mapInArrow(read, _RECORDS)


_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long, length long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in _RECORDS.split(", ")]
    return pa.record_batch([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


@query("op10_warc_writer", """
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, coalesce(html, '') AS body FROM pages),
judged AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS keep FROM sized)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM judged""")
def op10_warc_writer(spark, folder):
    """All pages written as archives and read back."""
    return read_archives(write_archives(table(spark, folder, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
