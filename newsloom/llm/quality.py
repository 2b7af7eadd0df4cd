"""Operator 5: quality classifier by an n-gram model with interpolated modified Kneser-Ney smoothing.

The model is over characters and of order ``ORDER``. A character is its code point, up to the end of the extended
Latin letters; the others share classes by a rule (``symbols``), so that a text of any script can be judged. The
model is trained on the trusted texts (those labelled good) but for one in ``HELD_OUT`` of them, chosen by a hash of the text.

Counts are sharded by the two characters before an n-gram's last one, which the contexts of all its orders above
the second share: a shard has all counts, continuation counts and back-off weights of those orders. The two lowest orders are
one dense table of a fixed size. Tasks send their counts to the shards as packed, sorted arrays. Documents are dealt into blocks in
turn; a block packs its texts once, asks each shard for the different n-grams that occur in it, and gets them back with
their probabilities. A shard's requests are answered one by one, after its counts were read; a shard is
repeated for each ``ANSWERS`` blocks. So no task holds more than a shard's counts and a request, or a block's packed texts, its
different n-grams with their answers, and what one part of its texts unpacks to.

A document's perplexity is per character. It is judged as if the text had ``PRIOR_CHARS`` characters more
at its language's median, as short texts vary more. A document is rejected if that is above an upper quantile of its
language. The quantile is of the held-out texts and far out (``TAIL`` lies beyond), where a sample has no texts yet: it
is the median and so many times the distance from it to the upper quartile, as in a normal law. A lower quantile is of no
use, as texts that share passages with trusted ones have low perplexities too.

Defined results: null or empty text has no perplexity and is kept; a null language is a language of its
own; a language with fewer than ``LEAST_HELD`` held-out texts has the quantiles of all languages' texts, and if those are fewer too,
all are kept; without any trusted text all are kept and have no perplexity; repeated rows are scored each; a label table
may repeat ids (the best label counts) and hold nulls (no label); all columns of the documents pass through ``keep``; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.support import block_count, scratch_names, stored

ORDER = 6
SYMBOL_BITS = 10
SYMBOLS = 1 << SYMBOL_BITS
PLAIN = 0x250  # code points of Latin letters with their extensions, which stand for themselves
HELD_OUT = 8
TAIL = 1e-6
LEAST_HELD = 20
PRIOR_CHARS = 200
PART_CHARS = 1 << 20
PACK_CHARS = 1 << 23
HELD_GRAMS = 1 << 22
ANSWERS = 1024
BROADCAST_IDS = 500_000
COUNTS, REQUEST = 0, 1
MESSAGE = "shard int, kind int, block int, grams binary, numbers binary"
BLOCK = "block int, doc_ids array<long>, hashes array<long>, langs array<string>, good array<int>, sizes array<int>, texts binary"


@lru_cache(1)
def symbols() -> np.ndarray:
    """The class of each code point, below SYMBOLS: white space is one class, other code points up to PLAIN are their
    own, and the rest share what is left by their number modulo it."""
    table = PLAIN + np.arange(0x110000) % (SYMBOLS - PLAIN)
    table[:PLAIN] = np.arange(PLAIN)
    table[[c for c in range(0x3001) if chr(c).isspace()]] = 0x20
    return table.astype(np.int64)


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(code of the ``order`` characters that end at each character, number of each text's
    characters); what stands before a text counts as space."""
    gap = " " * (order - 1)
    joined = np.frombuffer((gap + gap.join(texts)).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = symbols()[joined]
    count = len(kinds) - order + 1
    codes = np.zeros(max(0, count), dtype=np.int64)
    for k in range(order):
        codes = (codes << SYMBOL_BITS) | kinds[k : k + len(codes)]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if len(texts) > 1:
        keep = np.ones(len(codes), dtype=bool)
        gaps = np.cumsum(sizes[:-1]) + (order - 1) * np.arange(len(texts) - 1)
        keep[(gaps[:, None] + np.arange(order - 1)).ravel()] = False
        codes = codes[keep]
    return codes, sizes


def _parts(texts: list[str]) -> Iterator[list[str]]:
    low, chars = 0, 0
    for high, text in enumerate(texts):
        chars += len(text)
        if chars >= PART_CHARS or high == len(texts) - 1:
            yield texts[low : high + 1]
            low, chars = high + 1, 0


def packed(numbers: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<i8")[:, None].view(np.uint8).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def pack_grams(codes: np.ndarray) -> bytes:
    """Ascending codes, as the steps between them."""
    return packed(np.diff(codes, prepend=0))


def unpack_grams(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw))


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of the two characters before the last one."""
    pair = codes >> SYMBOL_BITS
    pair &= SYMBOLS**2 - 1
    mixed = pair.view(np.uint64)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    mixed >>= np.uint64(33)
    return mixed.view(np.int64) % shards


def _by_shard(codes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order that puts codes shard by shard, still ascending; where each shard ends)."""
    of = shard_of(codes, shards).astype(np.int16)  # sorted by digits
    return np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=shards))


def merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in ascending order, with the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _added(codes: np.ndarray, counts: np.ndarray, new: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``merged`` of ascending codes with a few ascending new ones, without sorting all; ``counts`` is changed in place."""
    at = np.searchsorted(codes, new)
    known = at < len(codes)
    known[known] = codes[at[known]] == new[known]
    counts[at[known]] += times[known]
    if known.all():
        return codes, counts
    return np.insert(codes, at[~known], new[~known]), np.insert(counts, at[~known], times[~known])


def _message(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=[x.split()[0] for x in MESSAGE.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Documents dealt to the blocks in turn, packed together as far as a task holds them."""
    names, kinds = zip(*(x.split() for x in BLOCK.split(", ")))
    types = {"int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
    turn, chars, waiting = TaskContext.get().partitionId() * 7919, 0, {}

    def made():
        rows = []
        for block, docs in waiting.items():
            columns = list(zip(*docs))
            raw = [t.encode("utf-8", "surrogatepass") for t in columns[4]]
            rows.append((block, *map(list, columns[:4]), [len(x) for x in raw], zstandard.compress(b"".join(raw), 3)))
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=list(names))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            waiting.setdefault(turn % blocks, []).append(row)
            turn, chars = turn + 1, chars + len(row[4])
            if chars >= PACK_CHARS:
                yield made()
                chars = 0
    yield made()


def _texts(row: dict) -> list[str]:
    raw, ends = zstandard.decompress(row["texts"]), np.cumsum(row["sizes"]).tolist()
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends)]


def _trained(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Counts of a task's trusted texts, for the shards."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def sent():
        order, ends = _by_shard(codes, shards)
        for shard, (low, high) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
            if high > low:
                yield _message([(shard, COUNTS, 0, pack_grams(codes[order[low:high]]), packed(counts[order[low:high]]))])

    for batch in batches:
        for part in _parts(batch.column(0).to_pylist()):
            new, times = np.unique(grams(part)[0], return_counts=True)
            codes, counts = _added(codes, counts, new, times)
            if len(codes) > HELD_GRAMS:
                yield from sent()
                codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield from sent()


class Shard:
    """Counts of a shard's n-grams at all orders above the second."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {order: (codes, counts)}
        for level in range(order - 1, 1, -1):  # the second order's counts here are this shard's share
            tails = self.levels[level + 1][0] & ((1 << (SYMBOL_BITS * level)) - 1)
            self.levels[level] = np.unique(tails, return_counts=True)
        self.share = self.levels.pop(2)

    def facts(self) -> list[tuple[int, int, int]]:
        """How often counts 1 to 4 occur at each order, and the shard's share of the second order's counts."""
        rows = [(level, k, int((n == k).sum())) for level, (_, n) in self.levels.items() for k in (1, 2, 3, 4)]
        return rows + [(2, int(g), int(n)) for g, n in zip(*self.share)]

    def log_probabilities(self, asked: np.ndarray, cuts: dict[int, list[float]], pairs: np.ndarray) -> np.ndarray:
        """Log of the smoothed probability of each n-gram's last character after its others. ``pairs`` has the
        probabilities of the second order, by their two characters."""
        p = pairs[asked & (SYMBOLS**2 - 1)].astype(np.float64)
        for level in sorted(self.levels):
            codes, counts = self.levels[level]
            if not len(codes):
                continue
            saved = np.where(counts >= 3, cuts[level][2], np.where(counts >= 2, cuts[level][1], cuts[level][0]))
            contexts, first = np.unique(codes >> SYMBOL_BITS, return_index=True)
            total, left = np.add.reduceat(counts, first), np.add.reduceat(saved, first)
            own = asked & ((1 << (SYMBOL_BITS * level)) - 1)
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            kept = np.where(codes[at] == own, counts[at] - saved[at], 0.0)
            context = np.minimum(np.searchsorted(contexts, own >> SYMBOL_BITS), len(contexts) - 1)
            seen = contexts[context] == own >> SYMBOL_BITS
            p = np.where(seen, (kept + left[context] * p) / total[context], p)
        return np.log(p)


def _summed_shard(messages: pa.Table) -> pa.Table:
    """One message with all counts of a shard."""
    codes = [unpack_grams(x) for x in messages["grams"].to_pylist()]
    counts = [unpacked(x) for x in messages["numbers"].to_pylist()]
    codes, counts = merged(np.concatenate(codes), np.concatenate(counts))
    return pa.Table.from_batches([_message([(messages["shard"][0].as_py(), COUNTS, 0, pack_grams(codes), packed(counts))])])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for codes, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            columns = list(zip(*Shard(unpack_grams(codes), unpacked(counts)).facts()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["level", "item", "n"])


def discounts(times: dict[int, int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more, from how often counts 1 to 4 occur."""
    n = [0, *(times.get(k, 0) for k in (1, 2, 3, 4))]
    y = n[1] / max(1, n[1] + 2 * n[2])
    return [min(k - 0.05, max(0.05, k - (k + 1) * y * n[k + 1] / max(1, n[k]))) for k in (1, 2, 3)]


def smoothed(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Interpolated probabilities over the last axis: what the discounts leave of the counts, and the saved mass
    times the lower order; all of it where a context was never seen."""
    cuts = discounts({k: int((counts == k).sum()) for k in (1, 2, 3, 4)})
    saved = np.where(counts >= 3, cuts[2], np.where(counts >= 2, cuts[1], np.where(counts >= 1, cuts[0], 0.0)))
    total = counts.sum(axis=-1, keepdims=True)
    own = (counts - saved) / np.maximum(total, 1)
    left = np.where(total > 0, saved.sum(axis=-1, keepdims=True) / np.maximum(total, 1), 1.0)
    return own + left * below


def low_orders(counts: DataFrame) -> tuple[dict[int, list[float]], np.ndarray]:
    """(discounts of the orders above the second, probabilities of the second order). What goes to the driver is at most
    four numbers an order and SYMBOLS**2 for the second order."""
    rows = counts.select("grams", "numbers").mapInArrow(_facts, "level long, item long, n long").groupBy("level", "item").agg(F.sum("n").alias("n")).toPandas()
    cuts = {int(level): discounts(dict(zip(part["item"], part["n"]))) for level, part in rows[rows["level"] > 2].groupby("level")}
    pairs = np.zeros(SYMBOLS**2)
    second = rows[rows["level"] == 2]
    pairs[second["item"].to_numpy(np.int64)] = second["n"].to_numpy(np.float64)
    pairs = pairs.reshape(SYMBOLS, SYMBOLS)
    single = smoothed((pairs > 0).sum(axis=0).astype(np.float64), np.full(SYMBOLS, 1 / SYMBOLS))
    return cuts, smoothed(pairs, single).astype(np.float32).ravel()


def _block_parts(docs: pa.Table) -> Iterator[list[str]]:
    """The texts of a block part by part; one row of it is unpacked at a time."""
    for k in range(docs.num_rows):
        yield from _parts(_texts(docs.slice(k, 1).select(["sizes", "texts"]).to_pylist()[0]))


def _distinct(codes: np.ndarray) -> np.ndarray:
    codes = np.sort(codes)
    return codes[np.flatnonzero(np.diff(codes, prepend=-1))]


def _asked(docs: pa.Table, shards: int) -> pa.Table:
    """A block's requests to the shards."""
    codes, found, waiting = np.zeros(0, np.int64), [], 0
    for part in _block_parts(docs):
        found.append(_distinct(grams(part)[0]))
        waiting += len(found[-1])
        if waiting > PART_CHARS:
            codes, found, waiting = _distinct(np.concatenate([codes, *found])), [], 0
    codes, rows = _distinct(np.concatenate([codes, *found])), []
    order, ends = _by_shard(codes, shards)
    block = docs["block"][0].as_py() if docs.num_rows else 0
    for shard, (low, high) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
        if high > low:
            rows.append((shard, REQUEST, block, pack_grams(codes[order[low:high]]), b""))
    return pa.Table.from_batches([_message(rows)])


def _answered(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard and copy, counts first; each request is answered in the order of its n-grams."""
    cuts, pairs = model.value
    shard, of = None, None
    for batch in batches:
        for number, copy, kind, block, codes, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if (number, copy) != of:
                of, shard = (number, copy), Shard(np.zeros(0, np.int64), np.zeros(0, np.int64))
            if kind == COUNTS:
                shard = Shard(unpack_grams(codes), unpacked(counts))
                continue
            logs = shard.log_probabilities(unpack_grams(codes), cuts, pairs).astype(np.float16)
            raw = zstandard.compress(np.ascontiguousarray(logs[:, None].view(np.uint8).T).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([codes], pa.binary()), pa.array([raw], pa.binary())], names=["block", "grams", "logs"])


def _scores(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Log-probability of every text of one block, from the shards' answers."""
    codes, logs = [np.zeros(0, np.int64)], [np.zeros(0, np.float16)]
    for k in range(answers.num_rows):
        row = answers.slice(k, 1).to_pylist()[0]
        planes = np.frombuffer(zstandard.decompress(row["logs"]), dtype=np.uint8).reshape(2, -1)
        codes.append(unpack_grams(row["grams"]))
        logs.append(np.ascontiguousarray(planes.T).view(np.float16).ravel())
    codes, logs = np.concatenate(codes), np.concatenate(logs)
    order = np.argsort(codes)
    codes, logs = codes[order], logs[order].astype(np.float32)
    totals, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
    for part in _block_parts(docs):
        asked, lengths = grams(part)
        own, place = np.unique(asked, return_inverse=True)
        running = np.concatenate([[0.0], np.cumsum(logs[np.searchsorted(codes, own)][place], dtype=np.float64)])
        at = np.cumsum(lengths)
        totals.append(running[at] - running[at - lengths])
        sizes.append(lengths)
    kept = {new: pc.list_flatten(docs[name]) for new, name in (("doc_id", "doc_ids"), ("text_hash", "hashes"), ("lang", "langs"), ("good", "good"))}
    return pa.table(kept | {"total": pa.array(np.concatenate(totals)), "chars": pa.array(np.concatenate(sizes))})


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) of the labelled good documents, once each."""
    return labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_hash, lang, held, chars, log_ppl) of every row of ``docs``, in the shared folder; ``held`` says that a
    text is trusted and was held out of the model."""
    context = docs.sparkSession.sparkContext
    blocks = block_count(docs)
    shards = min(4096, 8 * blocks)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), lang.alias("lang"), text.alias("text"))
    good = trusted_ids(labels)
    # the ids are broadcast only below a size; above it the join shuffles
    small = good.count() <= BROADCAST_IDS
    marked = plain.join((F.broadcast(good) if small else good).withColumn("good", F.lit(1)), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(0)))
    marked = marked.select("doc_id", "text_hash", "lang", "good", "text")
    held = F.pmod("text_hash", F.lit(HELD_OUT)) == 0
    counts = marked.filter((F.col("good") == 1) & ~held).select("text").mapInArrow(lambda b: _trained(b, shards), MESSAGE)
    counts = stored(counts.groupBy("shard").applyInArrow(_summed_shard, MESSAGE))
    sent = context.broadcast(low_orders(counts))
    dealt = marked.mapInArrow(lambda b: _blocks(b, blocks), BLOCK)
    asked = dealt.groupBy("block").applyInArrow(lambda d: _asked(d, shards), MESSAGE)
    copies = F.explode(F.sequence(F.lit(0), F.lit(blocks // ANSWERS)))
    rows = asked.withColumn("copy", F.floor(F.col("block") / ANSWERS).cast("int")).unionByName(counts.withColumn("copy", copies))
    sorted_rows = rows.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind").select("shard", "copy", "kind", "block", "grams", "numbers")
    answers = sorted_rows.mapInArrow(lambda b: _answered(b, sent), "block int, grams binary, logs binary")
    made = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores, "doc_id long, text_hash long, lang string, good int, total double, chars long")
    any_model = not counts.isEmpty()
    log_ppl = F.when((F.col("chars") > 0) & F.lit(any_model), -F.col("total") / F.col("chars"))
    return stored(made.select("doc_id", "text_hash", "lang", ((F.col("good") == 1) & held).alias("held"), "chars", log_ppl.alias("log_ppl")))


def _shrunk(median: Column) -> Column:
    return (F.col("log_ppl") * F.col("chars") + median * PRIOR_CHARS) / (F.col("chars") + PRIOR_CHARS)


def limits(scored: DataFrame, tail: float = TAIL) -> DataFrame:
    """(every, lang, median, high) in logarithms, from the held-out texts of each language that has enough of them,
    and one row of all languages (``every``)."""
    held = scored.filter(F.col("held") & F.col("log_ppl").isNotNull())
    groups = F.array(F.struct(F.lit(False).alias("every"), F.col("lang").alias("lang")), F.struct(F.lit(True).alias("every"), F.lit(None).cast("string").alias("lang")))
    each = held.select(F.explode(groups).alias("of"), "log_ppl", "chars").select("of.*", "log_ppl", "chars")
    middle = each.groupBy("every", "lang").agg(F.percentile_approx("log_ppl", 0.5, 10_000).alias("median"), F.count("*").alias("texts")).filter(F.col("texts") >= LEAST_HELD)
    both = each.alias("e").join(middle.alias("m"), (F.col("e.every") == F.col("m.every")) & F.col("e.lang").eqNullSafe(F.col("m.lang")))
    judged = both.select("e.every", "e.lang", "median", _shrunk(F.col("median")).alias("judged"))
    cuts = judged.groupBy("every", "lang").agg(F.first("median").alias("median"), F.percentile_approx("judged", [0.5, 0.75], 10_000).alias("q"))
    far = NormalDist().inv_cdf(1 - tail) / NormalDist().inv_cdf(0.75)
    mid, high = F.col("q")[0], F.col("q")[1]
    return cuts.select("every", "lang", "median", (mid + far * (high - mid)).alias("high"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text_hash, lang, perplexity, limit, keep) of every row of ``docs``."""
    scored = scores(docs, labels)
    bounds = stored(limits(scored))
    own = bounds.filter("not every").select(F.col("lang").alias("of"), F.struct("median", "high").alias("own"))
    # at most one row
    whole = bounds.filter("every").select(F.struct("median", "high").alias("whole"))
    both = scored.join(own, F.col("lang").eqNullSafe(F.col("of")), "left").join(F.broadcast(whole), F.lit(True), "left")
    both = both.withColumn("b", F.coalesce("own", "whole"))
    judged = _shrunk(F.col("b.median"))
    keep = F.coalesce(judged <= F.col("b.high"), F.lit(True))
    return both.select("doc_id", "text_hash", "lang", F.exp("log_ppl").alias("perplexity"), F.exp("b.high").alias("limit"), keep.alias("keep"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with their columns as they were."""
    bad_id, bad_hash = scratch_names(docs, "bad_id", "bad_hash")
    bad = judge(docs, labels).filter(~F.col("keep")).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64(text) == F.col(bad_hash)), "left_anti")
