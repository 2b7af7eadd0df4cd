"""Operator 12: how five filters interact, from truth-table survival words.

A document fails some of the filters A to E (``fails``, a mask of five bits). Its survival word has 32 bits, one for each
subset of the filters: bit S is set if the document passes all filters of S. Positional popcounts of the words give,
for each part and label, how many documents survive each subset; all that the report says of an order of filters, of
redundancy, of unique failures and of Shapley sums follows from these 32 counts. The popcounts are carry-save: full
adders turn three words into a sum and a carry at all 32 positions at once, plane by plane. Documents of one text,
part and labels have one word; their number enters the adders plane by plane as well, by its binary digits, so a text
with billions of copies costs as much as one with few.

Steps: one pass over the texts finds A to D and the text's SHA-256 (only ids, parts, masks and hashes are shuffled
from there on); labels are joined by id; copies are counted by hash, id, part and labels, with partial counts
before each shuffle, which makes a text held by a third of all rows a few rows; the smallest id of a text passes E.

Defined results: null text counts as empty, null ``lang`` as the part ``''``; a row with a null id has no labels, never
fails E and makes no other row fail it; rows that repeat an id and a text are rows of their own, and pass or fail E together; a
document is good (toxic) if any of its label rows says 1; texts are read whole; other columns pass by unread; an empty table has
no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
# Least number of words, least share of distinct words and largest share of capitals (percent), marks.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 100, 80, 10, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: WORDS[fails] has bit S set where no filter of S fails.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not fails & s) for fails in range(SUBSETS)], np.uint32)
REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_fails(raw: bytes, n_chars: int) -> int:
    """The mask of the filters A to D that a text fails."""
    words = raw.split()  # of bytes: at \x20 and \x09-\x0D only
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    marked = len(raw) - len(raw.translate(None, MARKS))
    failed = [len(words) < MIN_WORDS, 100 * len(set(words)) < MIN_DISTINCT * len(words), 100 * capitals > MAX_CAPITALS * n_chars, marked > 0]
    return sum(f << k for k, f in enumerate(failed))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, fails = [], []
        for cell in batch.column(2):
            text = cell.as_py() or ""
            raw = text.encode()
            hashes.append(hashlib.sha256(raw).digest())
            fails.append(text_fails(raw, len(text)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.binary()), pa.array(fails, pa.int32())], names=["doc_id", "part", "sha", "fails"])


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, sha, fails) for every row, E aside."""
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_judged, "doc_id long, part string, sha binary, fails int")


def counted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, fails, n): numbers of documents by part, labels and the filters failed, E included, one row for each
    of these and text."""
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    # a third key deals out rows without an id, which meet no label, over all tasks
    said = said.filter("doc_id is not null and (good or toxic)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("deal", F.lit(0).cast("long"))
    copies = rows.groupBy("sha", "doc_id", "part", "fails").agg(F.count("*").alias("n"))
    dealt = copies.withColumn("deal", F.when(F.col("doc_id").isNull(), F.xxhash64("sha")).otherwise(0))
    known = dealt.join(said, ["doc_id", "deal"], "left").fillna(False, ["good", "toxic"])
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    unknown = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unknown")
    texts = known.groupBy("sha", "part", "fails", "good", "toxic").agg(F.sum("n").alias("n"), first, unknown)
    # a text has one row for each part and label here, however many copies
    least = F.min("first.doc_id").over(Window.partitionBy("sha"))
    passing = F.col("unknown") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = texts.withColumn("least", least).select(
        "part", "good", "toxic", F.explode(F.array(F.struct("fails", passing.alias("n")), F.struct((F.col("fails") + (1 << FILTERS.index("E"))).alias("fails"), (F.col("n") - passing).alias("n")))).alias("x")
    )
    return split.select("part", "good", "toxic", "x.fails", "x.n").filter("n > 0")


def positional_popcounts(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each of 32 positions the number of words with that bit set, a word counting ``counts`` times."""
    totals, carried, plane = np.zeros(32, np.int64), np.empty(0, np.uint32), 0
    while len(carried) or (counts >> plane).any():
        level, carries = np.concatenate([carried, words[(counts >> plane) & 1 == 1]]), []
        while len(level) > 1:
            n = max(len(level) // 3, 1)
            a, b = level[:n], level[n : 2 * n]
            c = level[2 * n : 3 * n] if len(level) > 2 else np.zeros(1, np.uint32)
            carries.append((a & b) | (c & (a ^ b)))
            level = np.concatenate([a ^ b ^ c, level[3 * n :]])
        if len(level):
            totals += ((level[0] >> np.arange(32, dtype=np.uint32)) & 1).astype(np.int64) << plane
        carried, plane = np.concatenate(carries) if carries else np.empty(0, np.uint32), plane + 1
    return totals


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The survivors of each subset in each batch, by part and labels."""
    for batch in batches:
        part = batch.column(0).dictionary_encode()
        key = np.asarray(part.indices) * 4 + np.asarray(batch.column(1).cast(pa.int8())) * 2 + np.asarray(batch.column(2).cast(pa.int8()))
        words, counts = WORDS[np.asarray(batch.column(3))], np.asarray(batch.column(4))
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        rows = [(int(key[at[0]]), positional_popcounts(words[at], counts[at])) for at in np.split(order, cuts) if len(at)]
        names = part.dictionary.take(pa.array([k // 4 for k, _ in rows], pa.int32()))
        flags = [pa.array([bool(k & bit) for k, _ in rows], pa.bool_()) for bit in (2, 1)]
        yield pa.RecordBatch.from_arrays([names, *flags, pa.array([n.tolist() for _, n in rows], pa.list_(pa.int64()))], names=["part", "good", "toxic", "survivors"])


def subset_survivors(counts: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): survivors of every subset of the filters by part, and how many are good and toxic."""
    each = counts.mapInArrow(_survivors, "part string, good boolean, toxic boolean, survivors array<long>")
    rows = each.select("part", F.col("good").alias("is_good"), F.col("toxic").alias("is_toxic"), F.posexplode("survivors").alias("subset", "n"))
    when = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return rows.groupBy("part", "subset").agg(F.sum("n").alias("n"), when("is_good").alias("good"), when("is_toxic").alias("toxic"))


def part_report(survivors: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of one part."""
    every, n = SUBSETS - 1, len(FILTERS)
    fails = [int(survivors[0] - survivors[1 << f]) for f in range(n)]
    unique = [int(survivors[every & ~(1 << f)] - survivors[every]) for f in range(n)]
    shapley = []
    for f in range(n):
        before = [s for s in range(SUBSETS) if not s >> f & 1]
        shapley.append(sum(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * int(survivors[s] - survivors[s | 1 << f]) for s in before))
    for order in permutations(range(n)):
        at = 0
        for step, f in enumerate(order, 1):
            after = at | 1 << f
            removed = int(survivors[at] - survivors[after])
            lost = [int(x[at] - x[after]) for x in (good, toxic)]
            yield "".join(FILTERS[k] for k in order), step, int(survivors[after]), removed, fails[f] - removed, unique[f], *lost, shapley[f]
            at = after


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in REPORT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.array([(x["n"], x["good"], x["toxic"]) for x in sorted(row["subsets"], key=lambda x: x["subset"])], np.int64)
            rows = [(row["part"], *x) for x in part_report(*counts.T)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    survivors = subset_survivors(counted(judged(docs), labels))
    parts = survivors.groupBy("part").agg(F.collect_list(F.struct("subset", "n", "good", "toxic")).alias("subsets"))  # 32 of each part
    return parts.mapInArrow(_report, REPORT)
