"""Long XML logs read by many tasks: byte ranges, their lexical states, and ordinals by a prefix sum.

A range begins at its first ``<``. In an XML document such a byte opens a tag or lies inside a comment, a CDATA section
or a processing instruction; nowhere else. So one pass over a range finds, for each of these four beginnings, how it ends:
the state, the change of depth, and how many elements open at each depth. These small summaries, one row per range, are
composed in order of the ranges, which gives every range its true state, depth and first ordinal. Then each range parses
the records that begin in it: from its first record to the first one that begins behind it, after the file's own prolog
and root tag, so that encodings, namespaces and errors are those of the whole file. Every byte is parsed exactly once.

A log of 16-bit characters is one range. A log whose tags do not close is an error, as when it is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SUMMARIES = "path string, part int, start bigint, ends array<struct<state:int,delta:int,opens:map<int,bigint>>>"
STARTS = "path string, part int, start bigint, state int, depth int, ordinal bigint"


def _lexer():
    """Functions over bytes; nested, so that executors get them by value."""
    import re

    text, comment, cdata, instruction, broken = 0, 1, 2, 3, -1
    closers = {comment: b"-->", cdata: b"]]>", instruction: b"?>"}
    tag = re.compile(rb"[^\"'>]*(?:\"[^\"]*\"[^\"'>]*|'[^']*'[^\"'>]*)*>")
    wide_heads = (b"\xff\xfe", b"\xfe\xff", b"\x00<", b"<\x00")

    def leave(data: bytes, at: int, end: int, state: int) -> int | None:
        """Where text goes on after the open construct of ``state``; none if it stays open."""
        if state == text:
            return at
        found = data.find(closers[state], at, end)
        return None if found < 0 else found + len(closers[state])

    def walk(data: bytes, at: int, end: int, depth: int, opened) -> tuple[int, int]:
        """State and depth at ``end``, from text at ``at``; ``opened(place, depth)`` sees every opening tag and stops by returning true."""
        while True:
            at = data.find(b"<", at, end)
            if at < 0:
                return text, depth
            kind = data[at + 1:at + 2]
            if kind == b"!" and data.startswith(b"<!--", at):
                state, begin = comment, at + 4
            elif kind == b"!" and data.startswith(b"<![CDATA[", at):
                state, begin = cdata, at + 9
            elif kind == b"?":
                state, begin = instruction, at + 2
            else:
                found = tag.match(data, at + 1, end)
                if found is None:
                    return broken, depth
                stop = found.end()
                if kind == b"/":
                    depth -= 1
                elif kind != b"!":
                    if opened(at, depth):
                        return text, depth
                    depth += data[stop - 2] != 0x2F
                at = stop
                continue
            begin = leave(data, begin, end, state)
            if begin is None:
                return state, depth
            at = begin

    def summary(data: bytes, at: int, end: int, state: int) -> dict:
        opens: dict[int, int] = {}

        def seen(_: int, depth: int) -> bool:
            opens[depth] = opens.get(depth, 0) + 1
            return False

        begin = leave(data, at, end, state)
        if begin is None:
            return {"state": state, "delta": 0, "opens": {}}
        last, depth = walk(data, begin, end, 0, seen)
        return {"state": last, "delta": depth, "opens": opens}

    def first_record(data: bytes, at: int, end: int, state: int, depth: int) -> int:
        place = []

        def seen(where: int, now: int) -> bool:
            if now == 1:
                place.append(where)
            return now == 1

        walk(data, leave(data, at, end, state), end, depth, seen)
        return place[0]

    def until_tag(source, low: int, high: int) -> bytes:
        """Bytes of a range and on to the next ``<`` or the end of the file."""
        source.seek(low)
        data = source.read(high - low)
        while len(data) >= high - low and (more := source.read(1 << 12)):
            found = more.find(b"<")
            data += more if found < 0 else more[:found]
            if found >= 0:
                break
        return data

    def prolog(source) -> bytes:
        """The file up to its root's opening tag, with it."""
        size = 1 << 14
        while True:
            source.seek(0)
            data, place = source.read(size), []
            walk(data, 0, len(data), 0, lambda at, _: place.append(at) or True)
            if place:
                return data[:tag.match(data, place[0] + 1).end()]
            if len(data) < size:
                raise ValueError("no root element")
            size *= 4

    def is_wide(source) -> bool:
        source.seek(0)
        return source.read(2) in wide_heads

    return text, broken, summary, first_record, until_tag, prolog, is_wide


def summarise(split: int):
    """Rows of ``SUMMARIES`` for (path, part)."""
    text, _, summary, _, until_tag, _, is_wide = _lexer()
    opened = _by_value_open()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for path, part in zip(frame["path"], frame["part"]):
                with opened(path) as source:
                    same = [{"state": s, "delta": 0, "opens": {}} for s in range(4)]
                    if is_wide(source):
                        out.append((path, part, None, same))
                        continue
                    low = part * split
                    data = until_tag(source, low, low + split)
                    at = 0 if part == 0 else data.find(b"<", 0, split)
                    if at < 0:
                        out.append((path, part, None, same))
                        continue
                    ends = [summary(data, at, len(data), s) for s in (range(4) if part else [text])]
                    out.append((path, part, low + at, ends))
            yield pd.DataFrame(out, columns=["path", "part", "start", "ends"]).astype({"start": "Int64"})

    return rows


def _by_value_open():
    def opened(path: str):
        from urllib.parse import quote

        from pyarrow import fs

        place, name = fs.FileSystem.from_uri(quote(path, safe="/:@[]"))  # Spark shows paths unquoted
        return place.open_input_file(name)

    return opened


def compose():
    """The rows of one file's ranges, one per range, to those that have records: ``STARTS``."""
    text, broken = _lexer()[:2]

    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        out, state, depth, ordinal = [], text, 0, 0
        for path, part, start, ends in frame.sort_values("part").itertuples(index=False):
            end = ends[state if part else 0]
            opens = dict(end["opens"])
            records = opens.get(1 - depth, 0)
            if records or part == 0:
                out.append((path, part, start, state, depth, ordinal))
            ordinal, depth, state = ordinal + records, depth + end["delta"], end["state"]
            if state == broken:
                raise ValueError(f"log cannot be read: {path}: a tag does not close in range {part}")
        return pd.DataFrame(out, columns=["path", "part", "start", "state", "depth", "ordinal"]).astype({"start": "Int64"})

    return rows


def parse(split: int, element_reader):
    """Elements (as ``element_reader`` gives them) of the records that begin in each range of ``STARTS``; the first range gives the root too."""
    _, _, _, first_record, until_tag, prolog, is_wide = _lexer()
    opened, read, step, most = _by_value_open(), element_reader(), 1 << 20, 2_000

    def pieces(source, at: int) -> Iterator[bytes]:
        source.seek(at)
        while data := source.read(step):
            yield data

    def elements(path: str, part: int, start, state: int, depth: int, ordinal: int) -> Iterator[tuple]:
        with opened(path) as source:
            if part == 0:
                yield from read(path, pieces(source, 0), stop=None if is_wide(source) else split)
                return
            head = prolog(source)
            low = int(start)
            data = until_tag(source, low, (part + 1) * split)
            begin = low + first_record(data, 0, len(data), state, depth)
            yield from read(path, pieces(source, begin), prolog=head, ordinal=ordinal, begin=begin, stop=(part + 1) * split)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source_path", "ordinal", "name", "attrs", "children"]
        held: list[tuple] = []
        for frame in batches:
            for line in frame[["path", "part", "start", "state", "depth", "ordinal"]].itertuples(index=False):
                for row in elements(*line):
                    held.append(row)
                    if len(held) >= most:
                        yield pd.DataFrame(held, columns=names)
                        held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    return rows


TASK_BYTES = 1 << 26  # what a task reads, unless a range is longer


def task_count(ranges: int, size: int, parallelism: int) -> int:
    """Tasks for so many ranges of ``size`` bytes together: one for each while these are few or long, else as many as the bytes or the cores need.

    A task reads its ranges one after the other, so its memory is that of one range; what a task costs to start is not paid for every short range.
    """
    return max(1, min(ranges, max(-(-size // TASK_BYTES), 4 * parallelism), 100_000))


def read_split(files: DataFrame, split: int, element_reader, schema: str) -> DataFrame:
    """Elements of long files (path, length), ``split`` bytes to a range."""
    last = F.expr(f"(greatest(length, 1) - 1) div {split}")
    n, size = (int(x) for x in files.agg(F.coalesce(F.sum(last + 1), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first())
    parts = files.select("path", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("part"))
    tasks = task_count(n, size, files.sparkSession.sparkContext.defaultParallelism)

    def spread(rows: DataFrame) -> DataFrame:
        """Ranges dealt to the tasks, neighbours to different ones, however small the rows."""
        return rows.repartitionById(tasks, F.pmod(F.hash("path").cast("long") + F.col("part"), F.lit(tasks)).cast("int"))

    found = spread(parts).mapInPandas(summarise(split), SUMMARIES)
    starts = found.repartition(tasks, "path").groupBy("path").applyInPandas(compose(), STARTS)  # a row per range
    return spread(starts).mapInPandas(parse(split, element_reader), schema)
