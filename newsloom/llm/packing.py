"""Operator 8: packing documents into sequences, by concatenating and cutting.

Pass one tokenises each partition and writes the ids with each document's offset in its partition.
Prefix sums over the partitions' token totals (one small row each) give every document its global
offset; pass two cuts the stream into windows of fixed length and emits a record for each piece.
No token is shuffled. Only the last sequence can be short.

Defined results: null text counts as empty, and an empty document is its end id alone; a document
longer than a window makes several pieces; repeated rows are packed each; other columns are ignored.
An empty table gives no pieces. A null id is an id like others. Ids are those of the vocabulary file's
library with its defaults: added tokens of the file (strings like ``<|endoftext|>``) inside a text have their own ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.bpe import merges
from newsloom.llm.support import stored

WINDOW = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _tokens(batches: Iterator[pa.RecordBatch], vocab_path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    tool = merges(vocab_path)
    kind = "<u2" if max(tool.size, end_id + 1) <= 1 << 16 else "<u4"
    part, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            piece = batch.slice(low, 512)
            packed, counts = [], []
            for ids, sizes in tool.encode_added([t or "" for t in piece.column(1).to_pylist()]):
                ends = np.cumsum(sizes)
                whole = np.insert(ids, ends, end_id).astype(kind)
                raw, ends = whole.tobytes(), ((ends + np.arange(1, len(ends) + 1)) * whole.itemsize).tolist()
                packed += [raw[a:b] for a, b in zip([0, *ends], ends)]
                counts.append(sizes + 1)
            counts = np.concatenate(counts)
            starts = done + np.cumsum(counts) - counts
            done += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(counts), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), piece.column(0), pa.array(packed, pa.binary())],
                names=["part", "local_start", "n_tokens", "doc_id", "ids"],
            )


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, count, begin, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
            ids = np.frombuffer(raw, dtype=f"<u{len(raw) // count}").astype("<u4").tobytes()
            start = 0
            while start < count:
                sequence, offset = divmod(begin + start, window)
                length = min(window - offset, count - start)
                rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), count, sequence, offset))
                start += length
        columns = list(zip(*rows)) or [[]] * 7
        names = [x.split()[0] for x in PIECES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def tokenise(docs: DataFrame, vocab_path: str, end_id: int = END_ID) -> DataFrame:
    """(part, local_start, n_tokens, doc_id, ids) as written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(lambda b: _tokens(b, vocab_path, end_id), "part int, local_start long, n_tokens long, doc_id long, ids binary"))


def pack(docs: DataFrame, vocab_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: which tokens of a document lie where in which sequence."""
    tokens = tokenise(docs, vocab_path, end_id)
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    # bases has one row of two numbers for each partition of the input, so its size is bounded
    placed = tokens.join(F.broadcast(bases), "part").select("doc_id", "n_tokens", (F.col("base") + F.col("local_start")).alias("begin"), "ids")
    return placed.mapInArrow(lambda b: _cut(b, window), PIECES)
