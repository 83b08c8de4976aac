"""Conversations as token sequences with a loss mask, assembled segment by segment.

Texts and markers never meet as strings before encoding: each text is encoded on its own, without special tokens, and
the markers are reserved ids spliced in between, so no text can make a marker. Read as text the sequence is as safe:
control strings inside texts get one backslash after their first character (a text that has such a backslash gets one
more, which makes it reversible). The mask comes from a running sum over +1 where an assistant text starts and -1 where
it ends; the place of a turn in its conversation comes from running sums over blocks of turns, so a conversation that
holds a third of all rows is many blocks and no single task.

Template: ``<s>`` opens a conversation; a user turn is ``[INST]`` text ``[/INST]``, a system turn ``<<SYS>>`` text
``<</SYS>>``, an assistant turn text ``</s>``, any other turn ``[ROLE]`` role ``[/ROLE]`` text ``</s>``.

Edge cases: null and empty texts are empty segments; a null role is an empty one; rows without a conversation id form
one conversation; rows of one turn number follow each other by role and text, null numbers come first; repeated rows
are repeated turns; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import query, stored, table

# fixed values of the template: control strings and their reserved ids, above the vocabulary of 50,256
CONTROL = {"<s>": 50256, "</s>": 50257, "[INST]": 50258, "[/INST]": 50259, "<<SYS>>": 50260, "<</SYS>>": 50261, "[ROLE]": 50262, "[/ROLE]": 50263}
_OPEN = {"user": "[INST]", "system": "<<SYS>>"}
_CLOSE = {"[INST]": "[/INST]", "<<SYS>>": "<</SYS>>"}
TURNS_IN_BLOCK = 1024

_INNER = "|".join(re.escape(x[1:]) for x in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)({_INNER})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_INNER})")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_loaded: dict = {}


def encoding(path: str):
    """The byte-level tokenizer with the reserved ids; one per worker."""
    if path not in _loaded:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("reserved", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=CONTROL)
    return _loaded[path]


def _turn_ids(coder, role: str, text: str, first: bool) -> tuple[list[int], list[int]]:
    """Ids of a turn, and the change of the mask at each of them (one more at the end)."""
    body = coder.encode_ordinary(escape(text))
    start = [CONTROL["<s>"]] if first else []
    if role in _OPEN:
        start, end = [*start, CONTROL[_OPEN[role]]], [CONTROL[_CLOSE[_OPEN[role]]]]
    elif role == "assistant":
        end = [CONTROL["</s>"]]
    else:
        start, end = [*start, CONTROL["[ROLE]"], *coder.encode_ordinary(escape(role)), CONTROL["[/ROLE]"]], [CONTROL["</s>"]]
    change = [0] * (len(start) + len(body) + len(end) + 1)
    if role == "assistant":
        change[len(start)] += 1
        change[len(start) + len(body)] -= 1
    return [*start, *body, *end], change


def formatted_turns(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """One row per turn: ``conv_id, place`` (0, 1, ...), ``start`` (ids before it in its conversation), ``ids`` (little-endian
    32 bit) and ``mask`` (a byte per id, 1 on assistant texts)."""
    path = path or tokenizer_path()

    def encode(batches):
        coder = encoding(path)
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            ids, masks = [], []
            for role, text, place in zip(at["role"].to_pylist(), at["text"].to_pylist(), at["place"].to_pylist()):
                found, change = _turn_ids(coder, role, text, place == 0)
                ids.append(np.array(found, "<u4").tobytes())
                masks.append(np.cumsum(change)[:-1].astype(np.uint8).tobytes())
            yield pa.record_batch([at["conv_id"], at["turn_block"], at["place"], pa.array([len(x) for x in masks], pa.int64()), pa.array(ids, pa.binary()), pa.array(masks, pa.binary())],
                                  names=["conv_id", "turn_block", "place", "n", "ids", "mask"])

    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                                 F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("turn_block", F.floor(F.col("turn") / TURNS_IN_BLOCK))
    inside = Window.partitionBy("conv_id", "turn_block")
    numbered = turns.withColumn("inside", F.row_number().over(inside.orderBy("turn", "role", "text")))
    numbered = _after_earlier_blocks(numbered, numbered.groupBy("conv_id", "turn_block").agg(F.count(F.lit(1)).alias("n")), F.col("inside") - 1, "place")
    coded = stored(numbered.select("conv_id", "turn_block", "place", "role", "text").mapInArrow(
        encode, "conv_id long, turn_block long, place long, n long, ids binary, mask binary"), "coded-turns")
    local = coded.withColumn("local", F.sum("n").over(inside.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    placed = _after_earlier_blocks(local, coded.groupBy("conv_id", "turn_block").agg(F.sum("n").alias("n")), F.col("local"), "start")
    return placed.select("conv_id", "place", "start", "ids", "mask")


def _after_earlier_blocks(rows: DataFrame, sizes: DataFrame, local, name: str) -> DataFrame:
    """``local`` plus the sizes of all earlier blocks of the conversation."""
    upto = Window.partitionBy("conv_id").orderBy("turn_block").rowsBetween(Window.unboundedPreceding, 0)
    before = sizes.select(F.col("conv_id").alias("_conv"), F.col("turn_block").alias("_block"), (F.sum("n").over(upto) - F.col("n")).alias("_before"))
    return (rows.join(before, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn_block").eqNullSafe(F.col("_block")))
            .withColumn(name, local + F.col("_before")).drop("_conv", "_block", "_before"))


def parse(ids: np.ndarray, coder) -> list[tuple[str, str]]:
    """Roles and texts of a run of whole turns."""
    values, at, turns = ids.tolist(), 0, []
    reserved = {v: k for k, v in CONTROL.items()}

    def upto(stop: str) -> str:
        nonlocal at
        end = values.index(CONTROL[stop], at)
        text, at = unescape(coder.decode(values[at:end])), end + 1
        return text

    while at < len(values):
        mark = reserved.get(values[at])
        if mark == "<s>":
            at += 1
        elif mark in _CLOSE:
            at += 1
            turns.append((next(r for r, m in _OPEN.items() if m == mark), upto(_CLOSE[mark])))
        elif mark == "[ROLE]":
            at += 1
            role = upto("[/ROLE]")
            turns.append((role, upto("</s>")))
        else:
            turns.append(("assistant", upto("</s>")))
    return turns


def read_back(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of every conversation, from the ids and the mask alone: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``. A digest runs over a conversation in order; it is streamed, never gathered."""
    path = path or tokenizer_path()

    def read(batches):
        coder = encoding(path)
        state = None

        def done():
            conv, n, whole, chars, loss, shown = state
            return pa.record_batch([pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([whole.hexdigest()]), pa.array([chars], pa.int64()),
                                    pa.array([loss.hexdigest()]), pa.array([shown], pa.int64())],
                                   names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for conv, raw, flags in zip(at["conv_id"].to_pylist(), at["ids"], at["mask"]):
                ids, mask = np.frombuffer(raw.as_buffer(), "<u4"), np.frombuffer(flags.as_buffer(), np.uint8)
                if state is None or state[0] != conv:
                    if state is not None:
                        yield done()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(ids, coder):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                under = unescape(coder.decode(ids[mask > 0].tolist()))
                state[3] += len(under)
                state[4].update(under.encode())
                state[5] += len(coder.decode(ids.tolist()))
        if state is not None:
            yield done()

    ordered = turns.select("conv_id", "place", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_TRAP = "</s>[INST] ok [/INST]"


@query("op2_chat_format", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\])', '\1\\\2\3', 'g'))
    + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4
      ELSE 17 + length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\])', '\1\\\2\3', 'g')) END AS shown FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(shown))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""")
def op2_chat_format(spark, folder):
    """All conversations, and one whose texts are control strings, formatted and read back."""
    trap = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{_TRAP}'), (-7L, 1L, 'assistant', '{_TRAP}') AS t(conv_id, turn, role, text)")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(trap)
    return read_back(formatted_turns(turns))
