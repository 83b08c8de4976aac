"""Token counts of documents in flat token files, found by a scan for the end-of-document id.

The files hold 16-bit ids and nothing else: no index, no lengths. They are read in blocks of fixed size, each by any
task; a block's separators come from one vectorised comparison. What a block cannot know alone (how many documents
ended before it, and how much of its first document lies in earlier blocks) is a prefix scan over one small row per
block. A block without separators passes its whole length on, so a document may span any number of blocks.

``write_tokens`` makes such files: every task writes under a name of its own attempt, and only files that Spark's
committed manifest names count, so lost and repeated tasks leave nothing behind that is read.

Edge cases: null and empty texts have 0 tokens; ids after the last separator of a file are a document marked as not
ended; an empty file has no documents; strings of special tokens inside a text are ordinary text; null ids are kept;
repeated rows are documents of their own; no rows give no files and no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .best_fit_packing import tokenizer_path
from .common import keyed_texts, new_folder, query, stored, table
from .kernels import block_of, pieces
from .word_tokens import WordTokens

END_ID = 49407  # end of text in the word tokenizer, below 2**16
BLOCK_TOKENS = 1 << 20
TASKS = 100_000  # that read files or blocks; more are read one after the other
ROLL_TOKENS = 1 << 27  # a task starts a new file after so many ids


def write_tokens(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, roll: int = ROLL_TOKENS) -> DataFrame:
    """Flat files of all texts' ids, each text followed by ``end_id``. Returns the manifest ``file, ordinal, doc_id``, a row per document.

    ``folder`` must be one that all executors reach through ``pyarrow.fs``; by default a new one in the shared checkpoint folder.
    """
    path = path or tokenizer_path()
    folder = folder or new_folder(docs.sparkSession, "tokens")

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        tokens, part, stream, number, written, ordinal = WordTokens(path, specials_as_text=True), TaskContext.get().partitionId(), None, 0, 0, 0
        if max(end_id, len(tokens.last) - 1) > 0xFFFF:
            raise ValueError("flat files hold ids of 16 bits")
        try:
            for batch in batches:
                for piece in pieces(batch):
                    ids, counts = tokens.encode(block_of(piece.column(1)))
                    flat = np.full(int(counts.sum()) + len(counts), end_id, "<u2")
                    flat[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                    if stream is None or written >= roll:
                        if stream is not None:
                            stream.close()
                        name = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}.u16"
                        stream, number, written, ordinal = store.open_output_stream(f"{root}/{name}"), number + 1, 0, 0
                    stream.write(flat.tobytes())
                    written += len(flat)
                    yield pa.record_batch([pa.array([name] * len(counts)), pa.array(np.arange(ordinal, ordinal + len(counts))), piece.column(0)],
                                          names=["file", "ordinal", "doc_id"])
                    ordinal += len(counts)
        finally:
            if stream is not None:
                stream.close()

    manifest = stored(keyed_texts(docs).mapInArrow(write, "file string, ordinal long, doc_id long"), "token-manifest")
    return manifest.withColumn("folder", F.lit(folder))


def _dealt(rows: DataFrame, n: int, *by: str) -> DataFrame:
    return rows.repartitionById(n, F.pmod(F.hash(by[0]).cast("long") + (F.col(by[1]) if by[1:] else F.lit(0)), F.lit(n)).cast("int"))


def scan_tokens(files: DataFrame, end_id: int = END_ID, block: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of flat files: ``folder, file, ordinal, n_tokens, ended``. ``files`` has ``folder, file``, each once."""
    def measure(batches):
        from pyarrow import fs

        for batch in batches:
            for folder, file in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                store, root = fs.FileSystem.from_uri(folder)
                n = store.get_file_info(f"{root}/{file}").size // 2
                starts = np.arange(0, n, block)
                yield pa.record_batch([pa.array([folder] * len(starts)), pa.array([file] * len(starts)), pa.array(np.arange(len(starts))), pa.array(starts),
                                       pa.array(np.minimum(block, n - starts))], names=["folder", "file", "block", "start", "length"])

    def scan(batches):
        from pyarrow import fs

        for batch in batches:
            for folder, file, number, start, length in zip(*(batch.column(i).to_pylist() for i in range(5))):
                store, root = fs.FileSystem.from_uri(folder)
                with store.open_input_file(f"{root}/{file}") as source:
                    ids = np.frombuffer(source.read_at(2 * length, 2 * start), "<u2")
                ends = np.flatnonzero(ids == end_id)
                # before the first separator, between separators, after the last: one row each
                sizes = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
                kinds = np.arange(len(sizes))
                yield pa.record_batch([pa.array([folder] * len(sizes)), pa.array([file] * len(sizes)), pa.array(np.full(len(sizes), number)), pa.array(kinds),
                                       pa.array(sizes), pa.array(np.full(len(sizes), len(ends)))], names=["folder", "file", "block", "k", "size", "ends"])

    spans = "folder string, file string, block long, start long, length long"
    # a task for every few blocks however small their rows: adaptive execution would put them all into one
    n = min(TASKS, max(1, files.count()))
    listed = stored(_dealt(files.select("folder", "file"), n, "file").mapInArrow(measure, spans), "token-blocks")
    blocks = _dealt(listed, min(TASKS, max(1, listed.count())), "file", "block")
    found = stored(blocks.mapInArrow(scan, "folder string, file string, block long, k long, size long, ends long"), "separators")
    # prefix scan over one row per block: what it leaves open, and how many documents it ends
    in_file = Window.partitionBy("folder", "file").orderBy("block")
    upto = in_file.rowsBetween(Window.unboundedPreceding, 0)
    last = (found.where("k = ends").select("folder", "file", "block", "ends", F.col("size").alias("open"))
            .withColumns({"run": F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(upto), "ended": F.sum("ends").over(upto)}))
    grown = last.withColumn("open_after", F.sum("open").over(Window.partitionBy("folder", "file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    carried = grown.select("folder", "file", "block", (F.col("ended") - F.col("ends")).alias("before"), F.coalesce(F.lag("open_after").over(in_file), F.lit(0)).alias("carry"))
    inside = (found.where("k < ends").join(carried, ["folder", "file", "block"])
              .select("folder", "file", (F.col("before") + F.col("k")).alias("ordinal"), (F.col("size") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"),
                      F.lit(True).alias("ended")))
    final = grown.groupBy("folder", "file").agg(F.max(F.struct("block", "open_after", "ended")).alias("last"))
    rest = final.where("last.open_after > 0").select("folder", "file", F.col("last.ended").alias("ordinal"), F.col("last.open_after").alias("n_tokens"), F.lit(False).alias("ended"))
    return inside.union(rest)


@query("op1_separator_scan")
def op1_separator_scan(spark, folder):
    """Token counts of all documents: written as flat token files, counted by a scan for separators."""
    manifest = write_tokens(table(spark, folder, "documents"))
    counted = scan_tokens(manifest.select("folder", "file").distinct())
    return manifest.join(counted, ["folder", "file", "ordinal"]).select("doc_id", "n_tokens")
