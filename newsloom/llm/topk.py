"""Operator 7: exact top-k by inner product with vector-approximation files.

Components become integers floor(scale * x). Equal vectors are one entry of the file, with its k + 1 smallest
ids, which are all that a result can name. An entry has cells, one byte a dimension, and
the exact vector; they are columns of one table, so that a scan of the cells reads no exact vector.

Each dimension has its own cells, from counts over all vectors: components are counted by magnitude bins (of all tasks together, with the
least and the largest value in each), close bins are joined while there are more than ``GROUPS``, and the other cells are dealt to the
groups by the root of count times width, which makes the expected width of a component's cell least. A cell ends at values that
occur, so one very large component widens no other cell.

Cells and queries meet in tiles: blocks of at most ``WAVE`` query vectors by splits of the file. A tile streams: its queries come first, then
its cells, ``SCAN`` at a time, and every score is bounded from both sides. An entry that k + 1 others beat for certain is
left out. What is left is ordered by upper bound, and exact vectors are read (joined by entry) from the highest bound down, in
steps that grow, until no unread bound reaches the k-th best exact score: then the result is certain. All tiles are
one job; only beyond ``BLOCKS`` blocks are there further rounds, so that no more than so many copies of the cells lie in shuffle files at once.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; only
vectors of one length are compared; a row with a null id is a candidate, never a query, and ranks
after other ids at equal scores; rows with repeated ids are rows of their own (each query row leaves
out one row: its own); an empty table gives no rows; other columns are ignored. Scores must fit 63 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.support import stored

SCALE = 256
CELLS = 256
GROUPS = 128
DETAIL = 2  # magnitude bins: so many bits after the leading one
WAVE = 2048
WAVE_BYTES = 64 << 20
SPLIT = 8 * WAVE  # entries of a tile; a query's component has eight bytes, a cell one
BLOCKS = 256
SCAN = 2048
FIRST_STEP = 16
BINNED = "position int, bin int, n long, low long, high long"
MEMBER = "struct<no_id:boolean,vec_id:long,row:long>"
FILE = f"entry string, dim int, cells binary, exact array<long>, members array<{MEMBER}>, queried boolean"
TILES = f"block int, split int, query long, entry string, dim int, cells binary, first_id {MEMBER}, vector array<long>"
BOUNDED = f"query long, entry string, first_id {MEMBER}, low double, high double"


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, exact) of the vectors that take part, in the shared folder."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    usable = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return stored(rows.filter(usable).select("row", "vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("exact")))


def by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors as rows) of each length among lists of integers."""
    ends = vectors.offsets.to_numpy().astype(np.int64)
    values, sizes = vectors.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        yield own, values[ends[own][:, None] + np.arange(size)].reshape(len(own), size)


def bins(x: np.ndarray, detail: int) -> np.ndarray:
    """Ascending in x: zero, or the sign with the exponent and the first bits of the magnitude."""
    part, exponent = np.frexp(np.abs(x.astype(np.float64)))
    at = (exponent.astype(np.int64) << detail) + ((part - 0.5) * (2 << detail)).astype(np.int64) + 1
    return np.where(x == 0, 0, np.sign(x) * at)


def _joined_bins(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.groupby(["position", "bin"], as_index=False).agg(n=("n", "sum"), low=("low", "min"), high=("high", "max"))


def _binned(batches: Iterator[pa.RecordBatch], detail: int) -> Iterator[pa.RecordBatch]:
    """A task's counts; as many rows at most as there are bins."""
    held, kinds = None, {"position": "int32", "bin": "int32", "n": "int64", "low": "int64", "high": "int64"}
    for batch in batches:
        for _, block in by_length(batch.column(0)):
            for low in range(0, len(block), SCAN):
                part = block[low : low + SCAN]
                x, position = part.ravel(), np.tile(np.arange(part.shape[1]), len(part))
                new = _joined_bins(pd.DataFrame({"position": position, "bin": bins(x, detail), "n": 1, "low": x, "high": x}))
                held = new if held is None else _joined_bins(pd.concat([held, new]))
    if held is not None and len(held):
        yield pa.RecordBatch.from_pandas(held.astype(kinds)[list(kinds)], preserve_index=False)


def cells_of(counts: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) value of each of ``CELLS`` cells at most, from ascending bins of one dimension."""
    counts, lows, highs = counts.astype(np.float64), lows.astype(np.int64), highs.astype(np.int64)
    while len(counts) > GROUPS:  # the two neighbours whose joining widens components least
        wide = (highs - lows).astype(np.float64) * counts
        cost = (counts[:-1] + counts[1:]) * (highs[1:].astype(np.float64) - lows[:-1]) - wide[:-1] - wide[1:]
        k = int(np.argmin(cost))
        counts[k] += counts[k + 1]
        highs[k] = highs[k + 1]
        counts, lows, highs = np.delete(counts, k + 1), np.delete(lows, k + 1), np.delete(highs, k + 1)
    wide = highs.astype(np.float64) - lows
    share = np.sqrt(counts * wide)
    spare = np.floor((CELLS - len(counts)) * share / max(1e-300, share.sum()))
    parts = 1 + np.minimum(spare, wide).astype(np.int64)
    first, last = [], []
    for low, high, n in zip(lows.tolist(), highs.tolist(), parts.tolist()):
        starts = [low + (high - low + 1) * j // n for j in range(n)]
        first += starts
        last += [s - 1 for s in starts[1:]] + [high]
    return np.array(first, dtype=np.int64), np.array(last, dtype=np.int64)


def cell_grid(rows: DataFrame, detail: int = DETAIL) -> list[tuple[np.ndarray, np.ndarray]]:
    """The cells of each position of a vector. What reaches the driver is the bins of each position, however many rows there are."""
    found = rows.select("exact").mapInArrow(lambda b: _binned(b, detail), BINNED).groupBy("position", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = found.toPandas().sort_values(["position", "bin"])
    return [cells_of(part["n"].to_numpy(), part["low"].to_numpy(), part["high"].to_numpy()) for _, part in found.groupby("position")]


def _with_cells(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    grid = sent.value
    for batch in batches:
        cells = [b""] * batch.num_rows
        for own, block in by_length(batch.column(1)):
            codes = np.empty(block.shape, dtype=np.uint8)
            for k in range(block.shape[1]):
                codes[:, k] = np.searchsorted(grid[k][0], block[:, k], side="right") - 1
            for place, row in zip(own.tolist(), codes):
                cells[place] = row.tobytes()
        entry, exact, members, queried = batch.columns
        dims = pa.array(np.diff(exact.offsets.to_numpy()), pa.int32())
        yield pa.RecordBatch.from_arrays([entry, dims, pa.array(cells, pa.binary()), exact, members, queried], names=["entry", "dim", "cells", "exact", "members", "queried"])


def entry_of(exact: str) -> Column:
    """The name of a vector: equal ones have one, and none can be made for two."""
    return F.sha2(F.array_join(F.transform(exact, lambda x: x.cast("string")), ","), 256)


def approximation_file(rows: DataFrame, is_query: Column, members: int, detail: int = DETAIL, grid: list | None = None) -> DataFrame:
    """(entry, dim, cells, exact, members, queried): a row for each different vector, in the shared folder.
    Only the ``members`` smallest ids of a vector are kept, and they alone are shuffled: the limit of the
    window works before the shuffle, so one very common vector is a few rows a task."""
    sent = rows.sparkSession.sparkContext.broadcast(cell_grid(rows, detail) if grid is None else grid)
    keyed = rows.withColumn("entry", entry_of("exact"))
    member = F.struct(F.col("vec_id").isNull().alias("no_id"), "vec_id", "row")
    order = Window.partitionBy("entry", F.coalesce(is_query, F.lit(False))).orderBy(member)
    few = keyed.select("entry", "exact", "vec_id", is_query.alias("asks"), member.alias("member"), F.row_number().over(order).alias("n")).filter(F.col("n") <= members)
    entries = few.groupBy("entry").agg(F.first("exact").alias("exact"), F.slice(F.array_sort(F.collect_list("member")), 1, members).alias("members"), F.max(F.coalesce("asks", F.lit(False))).alias("queried"))
    return stored(entries.select("entry", "exact", "members", "queried").mapInArrow(lambda b: _with_cells(b, sent), FILE))


class _Scan:
    """Bounds of one block's queries of one length, over the cells of a tile."""

    def __init__(self, numbers: list[int], vectors: list[list[int]], grid: list, keep: int):
        self.numbers, self.keep = np.array(numbers), keep
        self.exact = np.array(vectors, dtype=np.float64).reshape(len(vectors), -1)
        self.sizes = np.abs(self.exact)
        dim = self.exact.shape[1]
        self.ends = np.zeros((2, dim, CELLS))
        for k in range(dim):
            for side in (0, 1):
                self.ends[side, k, : len(grid[k][side])] = grid[k][side]
        self.best: list[list[tuple]] = [[] for _ in numbers]  # (-lower bound, first id) of the best entries so far
        self.least = np.full(len(numbers), -np.inf)

    def bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bound of each query's score with each entry. Whole numbers, and exact below 2**51; above it as much
        wider as rounding can be off."""
        dim = np.arange(cells.shape[1])
        least, most = self.ends[0][dim, cells], self.ends[1][dim, cells]
        middle, reach = self.exact @ (least + most).T, self.sizes @ (most - least).T
        largest = np.maximum(np.abs(least), np.abs(most)).max(axis=1, initial=0.0)
        size = self.sizes.sum(axis=1)[:, None] * largest[None, :]
        off = np.where(size < 2.0**51, 0.0, size * (4 * len(dim) + 8) * np.finfo(np.float64).eps)
        return (middle - reach) / 2 - off, (middle + reach) / 2 + off

    def scan(self, entries: list[str], firsts: list[tuple], cells: np.ndarray) -> Iterator[tuple]:
        lower, upper = self.bounds(cells)
        for q in np.flatnonzero(upper.max(axis=1) >= self.least):
            low, high = lower[q], upper[q]
            likely = np.flatnonzero(high >= self.least[q])
            lows = low[likely]
            if len(likely) > self.keep:  # the best lower bounds of this stretch, with all their ties
                lows = lows[lows >= np.partition(lows, len(lows) - self.keep)[len(lows) - self.keep]]
                few = likely[low[likely] >= lows.min()]
            else:
                few = likely
            self.best[q] = sorted(self.best[q] + [(-low[i], firsts[i]) for i in few.tolist()])[: self.keep]
            full = len(self.best[q]) == self.keep
            if full:
                self.least[q] = -self.best[q][-1][0]
                likely = likely[high[likely] >= self.least[q]]
            for i in likely.tolist():
                # beaten for certain: as many others reach its upper bound, with smaller ids where they only equal it
                if not full or (-high[i], firsts[i]) <= self.best[q][-1]:
                    yield int(self.numbers[q]), entries[i], firsts[i], float(low[i]), float(high[i])


def _found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    first = pa.struct([("no_id", pa.bool_()), ("vec_id", pa.int64()), ("row", pa.int64())])
    kinds = [pa.int64(), pa.string(), first, pa.float64(), pa.float64()]
    for low in range(0, len(rows), 1 << 16):
        columns = list(zip(*rows[low : low + (1 << 16)]))
        columns[2] = [{"no_id": a, "vec_id": None if a else b, "row": c} for a, b, c in columns[2]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["query", "entry", "first_id", "low", "high"])


def _bounds(batches: Iterator[pa.RecordBatch], sent, keep: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile, queries before cells."""
    grid, tile, asked, scans = sent.value, None, {}, {}
    for batch in batches:
        blocks, splits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(splits) != 0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if end == start:
                continue
            if tile != (blocks[start], splits[start]):
                tile, asked, scans = (blocks[start], splits[start]), {}, {}
            for low in range(start, end, SCAN):
                part = batch.slice(low, min(SCAN, end - low))
                numbers, entries, dims, cells, firsts, vectors = (part.column(k).to_pylist() for k in range(2, 8))
                for number, dim, vector in zip(numbers, dims, vectors):
                    if number is not None:
                        asked.setdefault(dim, ([], []))[0].append(number)
                        asked[dim][1].append(vector)
                for dim in set(dims) & set(asked):
                    own = [k for k, d in enumerate(dims) if d == dim and numbers[k] is None]
                    if not own:
                        continue
                    if dim not in scans:
                        scans[dim] = _Scan(*asked[dim], grid, keep)
                    block = np.frombuffer(b"".join(cells[k] for k in own), dtype=np.uint8).reshape(len(own), dim)
                    ids = [(firsts[k]["no_id"], firsts[k]["vec_id"] or 0, firsts[k]["row"]) for k in own]
                    yield from _found(list(scans[dim].scan([entries[k] for k in own], ids, block)))


def bounded_scores(file: DataFrame, queries: DataFrame, grid: list, entries: int, blocks: int, keep: int) -> DataFrame:
    """(query, entry, first_id, low, high) of all entries that can be among the best of their tile; ``queries`` has
    (query, block, dim, vector)."""
    sent = file.sparkSession.sparkContext.broadcast(grid)
    splits = max(1, math.ceil(entries / SPLIT), min(file.rdd.getNumPartitions(), math.ceil(entries / SCAN)))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    cells = file.select(every(blocks, "block"), F.pmod(F.xxhash64("entry"), F.lit(splits)).cast("int").alias("split"), none("long", "query"), "entry", "dim", "cells", F.get("members", F.lit(0)).alias("first_id"), none("array<long>", "vector"))
    asking = queries.select("block", every(splits, "split"), "query", none("string", "entry"), "dim", none("binary", "cells"), none(MEMBER, "first_id"), "vector")
    tiles = asking.unionByName(cells).repartition("block", "split").sortWithinPartitions("block", "split", F.col("query").isNull())
    return stored(tiles.select(*[x.split()[0] for x in TILES.replace(f"first_id {MEMBER}", "first_id x").split(", ")]).mapInArrow(lambda b: _bounds(b, sent, keep), BOUNDED))


def _ranked(scores: DataFrame, keep: int, order: list) -> DataFrame:
    return scores.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("n") <= keep)


def read_in_order(file: DataFrame, bounded: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """(query, entry, first_id, score) of all exact vectors that were read: from the highest upper bound down, until
    no unread bound reaches the ``keep``-th best score. ``bounded`` has the bounds of all entries that can be
    among the best, ``queries`` (query, vector)."""
    # an entry whose upper bound is below the keep-th best lower bound of all tiles is not among the best
    sure = _ranked(bounded, keep, [F.desc("low"), "first_id"]).groupBy("query").agg(F.count("*").alias("have"), F.min("low").alias("sure"))
    near = bounded.join(sure, "query").filter((F.col("have") < keep) | (F.col("high") >= F.col("sure"))).select("query", "entry", "first_id", "high")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("high"), "first_id"))
    near = stored(near.select("*", place.alias("place")))
    exact = file.select("entry", "exact")
    product = F.aggregate(F.zip_with("exact", "vector", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    done, until, read, kth = 0, FIRST_STEP, None, None
    while True:  # a step is eight times the one before: as many steps as the longest list's length has digits
        open_rows = near.filter((F.col("place") > done) & (F.col("place") <= until))
        if kth is not None:
            open_rows = open_rows.join(kth, "query", "left").filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).drop("kth")
        new = open_rows.join(exact, "entry").join(queries, "query").select("query", "entry", "first_id", product.alias("score"))
        read = stored(new if read is None else read.unionByName(new))
        kth = _ranked(read, keep, [F.desc("score"), "first_id"]).groupBy("query").agg(F.count("*").alias("have"), F.min("score").alias("kth")).filter(F.col("have") >= keep).select("query", "kth")
        left = near.filter(F.col("place") > until).join(kth, "query", "left").filter(F.col("kth").isNull() | (F.col("high") >= F.col("kth")))
        if left.isEmpty():
            return read
        done, until = until, until * 8


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE, wave: int = WAVE, at_once: int = BLOCKS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (a condition on vec_id)
    selects, the k highest integer inner products with the other rows. ``wave`` query vectors are a block, and
    ``at_once`` blocks a round."""
    rows = integers(vectors, scale)
    grid = cell_grid(rows)
    file = approximation_file(rows, is_query, k + 1, DETAIL, grid)
    facts = file.agg(F.count("*").alias("entries"), F.count(F.when(F.col("queried"), 1)).alias("asked"), F.max("dim").alias("dim")).first()
    wave = max(1, min(wave, WAVE_BYTES // (8 * max(1, facts["dim"] or 1))))
    blocks = max(1, math.ceil(facts["asked"] / wave))
    numbered = file.filter("queried").select(F.monotonically_increasing_id().alias("query"), F.col("entry").alias("asked"), "dim", F.col("exact").alias("vector"))
    # entries are dealt by their hash, so a block has about ``wave`` of them
    queries = stored(numbered.withColumn("block", F.pmod(F.xxhash64("asked"), F.lit(blocks)).cast("int")))
    asks = rows.filter(is_query).select("row", F.col("vec_id").alias("query_id"), entry_of("exact").alias("asked"))
    out = None
    for low in range(0, blocks, at_once):
        own = queries.filter(F.col("block").between(low, low + at_once - 1)).withColumn("block", F.col("block") - low)
        bounded = bounded_scores(file, own, grid, facts["entries"], min(at_once, blocks - low), k + 1)
        read = read_in_order(file, bounded, own.select("query", "vector"), k + 1)
        best = _ranked(read, k + 1, [F.desc("score"), "first_id"]).select("query", "entry", "score")
        found = best.join(file.select("entry", "members"), "entry").join(own.select("query", "asked"), "query").select("asked", "score", F.explode("members").alias("m"))
        listed = F.collect_list(F.struct((-F.col("score")).alias("less"), "m.no_id", "m.vec_id", "m.row"))
        lists = stored(found.groupBy("asked").agg(F.slice(F.array_sort(listed), 1, k + 1).alias("best")))
        out = lists if out is None else out.unionByName(lists)
    # k + 1 results for each query vector; the rows that ask for them keep all but their own
    others = asks.join(out, "asked").select("query_id", F.slice(F.filter("best", lambda x: x["row"] != F.col("row")), 1, k).alias("best"))
    return others.select("query_id", F.posexplode("best").alias("n", "x")).select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score"))
