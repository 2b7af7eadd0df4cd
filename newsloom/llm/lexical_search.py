"""Operator 11: ranked lexical search by dual trees.

Items (the queries) and documents are vectors over the items' terms: an item has its terms' weights, a document the
impacts of their frequencies. Both get a hierarchy whose nodes hold the largest value of each coordinate. The product of
two nodes' maxima bounds every score between their items and documents; where it stays below the weakest k-th score of
the node's items, the whole batch of pairs is left out, else both nodes are opened. Scores of what is left are exact
integers, so the result is that of scoring all pairs.

Jobs. One pass over the texts writes each document's length and its frequencies of the items' terms; counts of
documents and terms follow from that table, in aggregates. A pilot over one document in ``PILOT`` gives each item a k-th
score to begin with; it decides nothing but how early batches are left out. Then each task streams all its documents
in blocks of bounded size, a hierarchy for each block, and keeps k rows an item; a rank with a limit before the
shuffle merges the tasks' rows. Items are searched in sets of about ``ITEM_CHARS`` characters, which alone are sent to tasks:
vocabulary, weights, hierarchy. More items are more sets, each a pass of its own; documents are never sent.

Defined results: null and empty texts have no terms (such items have no rows, such documents never match, and neither
counts); rows that repeat an id are items or documents of their own; equal scores rank by ascending ``doc_id``, null ids
last; an item with fewer than k documents above 0 has fewer rows; texts are read whole; empty tables give no rows;
other columns pass by unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.support import stored

K = 50
ITEM_CHARS = 1 << 20
PILOT = 64
LEAF = 16
BLOCK_DOCS, BLOCK_VALUES = 8192, 1 << 19
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Separators become a space, A-Z small letters; all bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
FOUND = "item int, item_id long, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order, as UTF-8."""
    return (text or "").encode().translate(FOLD).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n_terms: int, n_docs: int, all_terms: int) -> int:
    return 100 - 50 + (50 * n_terms * n_docs) // all_terms


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Hierarchy:
    """A binary tree over sparse rows (``ptr``, ``columns``, ``values``). ``order`` puts the rows of a node side by side (``low`` to
    ``high``); ``terms[node]`` and ``maxima[node]`` are its coordinates and their largest values. A node is split by having
    the column that is in nearest to half of its rows, or in the middle where no column is in between an eighth and seven."""

    def __init__(self, ptr: np.ndarray, columns: np.ndarray, values: np.ndarray, leaf: int):
        self.terms, self.maxima, self.low, self.high, self.left, self.right = [], [], [], [], [], []
        order, order_end, todo = [], 0, [(np.arange(len(ptr) - 1), -1, False)]
        while todo:
            rows, parent, is_right = todo.pop()
            node = len(self.low)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            sizes = ptr[rows + 1] - ptr[rows]
            at = ranges(ptr[rows], sizes)
            by_column = np.argsort(columns[at], kind="stable")
            own = columns[at][by_column]
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            self.terms.append(own[starts])
            self.maxima.append(np.maximum.reduceat(values[at][by_column], starts) if len(starts) else values[:0])
            self.low.append(order_end)
            self.left.append(-1)
            self.right.append(-1)
            self.high.append(self.low[-1] + len(rows))
            if len(rows) <= leaf:
                order.append(rows)
                order_end = self.high[-1]
                continue
            having = np.arange(len(rows)) < len(rows) // 2
            if len(starts):
                counts = np.diff(starts, append=len(own))
                best = np.argmin(np.abs(2 * counts - len(rows)))
                if len(rows) <= 8 * counts[best] <= 7 * len(rows):
                    having = np.zeros(len(rows), bool)
                    having[np.repeat(np.arange(len(rows)), sizes)[columns[at] == own[starts[best]]]] = True
            todo += [(rows[~having], node, True), (rows[having], node, False)]
        self.order = np.concatenate(order)
        self.low, self.high, self.left, self.right = (np.array(x) for x in (self.low, self.high, self.left, self.right))


class Items:
    """A set of items: vocabulary, then weights and hierarchy once documents are counted."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        found = [(item_id, sorted(set(terms(text)))) for item_id, text in rows]
        found = [x for x in found if x[1]]
        self.ids = [item_id for item_id, _ in found]
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for _, own in found for t in own}))}
        self.ptr = np.cumsum([0, *(len(own) for _, own in found)])
        self.columns = np.array([self.vocabulary[t] for _, own in found for t in own], np.int64)

    def weigh(self, n_docs: int, dfs: dict[int, int]) -> None:
        weights = np.array([term_weight(n_docs, dfs.get(k, 0)) for k in range(len(self.vocabulary))], np.int64)
        self.tree = Hierarchy(self.ptr, self.columns, weights[self.columns], 1)
        self.node_ptr = np.cumsum([0, *map(len, self.tree.terms)])
        self.node_terms, self.node_weights = np.concatenate(self.tree.terms), np.concatenate(self.tree.maxima)
        self.n_terms, self.vocabulary = len(self.vocabulary), None  # tasks that search need no words


class Search:
    """The k best documents of each item among all blocks given to it. Items are numbered in the order of their tree."""

    def __init__(self, items: Items, k: int, reached: np.ndarray):
        self.items, self.k, n = items, k, len(items.ids)
        # a score at or below kth (at kth: with an id that isn't below) changes nothing
        self.kth, self.kth_doc = np.append(reached[items.tree.order], HIGH), np.full(n, LOW)
        none = np.empty(0, np.int64)
        self.best = [(none, none, none)] * n
        self.place, self.scored = np.zeros(items.n_terms, np.int64), 0

    def kept(self, nodes: np.ndarray, maxima: np.ndarray, first_doc: int) -> np.ndarray:
        """The item nodes that some document below these maxima may still change."""
        it, tree = self.items, self.items.tree
        sizes = it.node_ptr[nodes + 1] - it.node_ptr[nodes]
        at = ranges(it.node_ptr[nodes], sizes)
        bounds = np.add.reduceat(it.node_weights[at] * maxima[self.place[it.node_terms[at]]], np.cumsum(sizes) - sizes)
        weakest = np.minimum.reduceat(self.kth, np.stack([tree.low[nodes], tree.high[nodes]], 1).ravel())[::2]
        single = tree.left[nodes] < 0
        tied = (bounds == weakest) & (~single | (first_doc < self.kth_doc[tree.low[nodes] * single]))
        return nodes[(bounds > weakest) | tied]

    def opened(self, nodes: np.ndarray) -> np.ndarray:
        tree = self.items.tree
        inner = nodes[tree.left[nodes] >= 0]
        return np.concatenate([nodes[tree.left[nodes] < 0], tree.left[inner], tree.right[inner]])

    def block(self, docs: np.ndarray, nulls: np.ndarray, ptr: np.ndarray, columns: np.ndarray, values: np.ndarray) -> None:
        """Takes documents in: ids (nulls as the largest number), and rows of impacts."""
        tree = Hierarchy(ptr, columns, values, LEAF)
        todo = [(0, np.zeros(1, np.int64))]
        while todo:
            node, alive = todo.pop()
            rows = tree.order[tree.low[node] : tree.high[node]]
            self.place[tree.terms[node]] = np.arange(1, len(tree.terms[node]) + 1)
            maxima, first = np.append(0, tree.maxima[node]), docs[rows].min()
            alive = self.kept(alive, maxima, first)
            if len(alive) and tree.left[node] >= 0:
                todo += [(tree.right[node], self.opened(alive)), (tree.left[node], self.opened(alive))]
            elif len(alive):
                while (self.items.tree.left[alive] >= 0).any():
                    alive = self.kept(self.opened(alive), maxima, first)
                if len(alive):
                    self.score(alive, rows, docs, nulls, ptr, columns, values, len(maxima))
            self.place[tree.terms[node]] = 0

    def score(self, alive: np.ndarray, rows: np.ndarray, docs: np.ndarray, nulls: np.ndarray, ptr: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> None:
        """Exact scores of single items and a leaf's documents; the better ones are taken in."""
        it = self.items
        sizes = ptr[rows + 1] - ptr[rows]
        at, dense = ranges(ptr[rows], sizes), np.zeros((n, len(rows)), np.int64)
        dense[self.place[columns[at]], np.repeat(np.arange(len(rows)), sizes)] = values[at]
        sizes = it.node_ptr[alive + 1] - it.node_ptr[alive]
        at = ranges(it.node_ptr[alive], sizes)
        scores = np.add.reduceat(it.node_weights[at, None] * dense[self.place[it.node_terms[at]]], np.cumsum(sizes) - sizes, axis=0)
        self.scored += scores.size
        numbers, own = it.tree.low[alive], docs[rows]
        better = (scores > self.kth[numbers, None]) | ((scores == self.kth[numbers, None]) & (own < self.kth_doc[numbers, None]))
        for k in np.flatnonzero(better.any(axis=1)):
            number, new = numbers[k], better[k]
            best = [np.concatenate(x) for x in zip(self.best[number], (scores[k, new], own[new], nulls[rows][new]))]
            first = np.lexsort((best[1], -best[0]))[: self.k]
            self.best[number] = tuple(x[first] for x in best)
            if len(first) == self.k:
                self.kth[number], self.kth_doc[number] = self.best[number][0][-1], self.best[number][1][-1]

    def found(self) -> Iterator[pa.RecordBatch]:
        for number, (scores, docs, nulls) in enumerate(self.best):
            if len(scores):
                item = int(self.items.tree.order[number])
                columns = [pa.array([item] * len(scores), pa.int32()), pa.array([self.items.ids[item]] * len(scores), pa.int64()), pa.array(docs, pa.int64(), mask=nulls.astype(bool)), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "doc_id", "score"])


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    known = vocabulary.value.get
    for batch in batches:
        lengths, sizes, columns, counts = [], [0], [], []
        for cell in batch.column(1):
            words = terms(cell.as_py())
            own, tf = np.unique(np.array([k for k in map(known, words) if k is not None], np.int32), return_counts=True)
            lengths.append(len(words))
            sizes.append(len(own))
            columns.append(own)
            counts.append(tf)
        ends = pa.array(np.cumsum(sizes), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], pa.int32())) for x in (columns, counts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row: its number of terms, and the frequencies of those in the vocabulary; in the
    shared folder."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(lambda b: _vectors(b, sent), "doc_id long, n long, terms array<int>, tfs array<int>"))


def _searched(batches: Iterator[pa.RecordBatch], sent, k: int, n_docs: int, all_terms: int) -> Iterator[pa.RecordBatch]:
    items, reached = sent.value
    search, waiting = Search(items, k, reached), []

    def flush() -> None:
        ids = pa.concat_arrays([b.column(0) for b in waiting])
        nulls = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        docs = ids.fill_null(HIGH).to_numpy()
        lists = pa.concat_arrays([b.column(2) for b in waiting])
        sizes = np.asarray(lists.value_lengths(), np.int64)
        m = np.array([length_part(n, n_docs, all_terms) for b in waiting for n in b.column(1).to_pylist()], np.int64)
        tf = np.asarray(pa.concat_arrays([b.column(3) for b in waiting]).flatten(), np.int64)
        search.block(docs, nulls, np.cumsum(np.append(0, sizes)), np.asarray(lists.flatten(), np.int64), impacts(tf, np.repeat(m, sizes)))
        waiting.clear()

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rows = sum(b.num_rows for b in waiting)
            room = BLOCK_VALUES - sum(len(b.column(2).flatten()) for b in waiting)
            ends = np.cumsum(np.asarray(batch.column(2).slice(at).value_lengths()))
            take = min(int(np.searchsorted(ends, room, side="right")), BLOCK_DOCS - rows)
            if take <= 0 and waiting:
                flush()
                continue
            waiting.append(batch.slice(at, max(take, 1)))
            at += max(take, 1)
    if waiting:
        flush()
    yield from search.found()


def _set_best(items: list[tuple[int | None, str | None]], docs: DataFrame, k: int) -> DataFrame | None:
    """(item_id, rank, doc_id, score) of one set of items."""
    own, context = Items(items), docs.sparkSession.sparkContext
    if not own.ids:
        return None
    rows = vectors(docs, own.vocabulary)
    total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total["terms"]:
        return None
    dfs = rows.select(F.explode("terms").alias("term")).groupBy("term").count()
    own.weigh(total["docs"], {r["term"]: r["count"] for r in dfs.collect()})  # at most a row for each term of the set
    matching = rows.filter(F.size("terms") > 0)

    def best(part: DataFrame, reached: np.ndarray) -> DataFrame:
        sent = context.broadcast((own, reached))
        found = part.mapInArrow(lambda b: _searched(b, sent, k, total["docs"], total["terms"]), FOUND)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    reached = np.zeros(len(own.ids), np.int64)
    pilot = best(matching.filter(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(PILOT)) == 0), reached)
    for r in pilot.filter(F.col("rank") == k).select("item", "score").collect():  # at most a row for each item of the set
        reached[r["item"]] = r["score"] - 1
    return best(matching, reached).select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item with scores above 0."""
    spark: SparkSession = docs.sparkSession
    rows = stored(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_sets = max(1, math.ceil(chars / ITEM_CHARS))
    numbered = rows.withColumn("set", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_sets)))
    sets = (_set_best([tuple(r) for r in numbered.filter(F.col("set") == k_).select("item_id", "text").collect()], docs, k) for k_ in range(n_sets))
    found = [df for df in sets if df is not None]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
