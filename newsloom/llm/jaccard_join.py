"""Operator 4: n-gram Jaccard join by MinHash banding, verified on full n-gram sets.

A text's n-grams are its runs of five lower-case words (all words of a shorter text). Texts with the same
words are one class, kept once with its smallest doc_id. Signatures of b bands of r rows are chosen so
that a pair at the wanted similarity shares a band with the wanted recall; rows are shuffled on band hashes, and
only classes in buckets of two or more go on.

Buckets may hold thousands of near copies, so pairs are never listed. Each class takes as home the largest
bucket that it or a class beside it in some bucket has; homes are cut into chunks of bounded text; a bucket names the chunks it spans, and each distinct
pair of chunks is a tile. A tile's task holds the full n-gram sets of at most two chunks, counts
all intersections at once by a matrix product over the n-grams that occur twice there, and returns for
each class its number of links and a link towards the smallest member of its part of the tile. As a class is in
one chunk, and a pair of chunks in one tile, every link is counted once. Groups are the connected
components of these links, found by alternating large and small stars in joins, written between rounds.

Result: one row a document with copy_id (smallest doc_id among texts of the same words), class_id (smallest
doc_id of its group), n_links (other texts at least as similar as the threshold) and n_copies.

Defined results: null text counts as empty; texts without words are copies of each other and have no
links; repeated rows with one id are one document each time they occur; rows with a null id have their
links, with ids taken from other members where there are some; an empty table gives no rows; other
columns are ignored by ``links`` and pass through ``first_of_each``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.simhash import hasher, shingle_hashes
from newsloom.llm.support import scratch_names, stored

SIMILARITY = 0.8
SHINGLE = 5
RECALL = 0.9999
MOST_HASHES = 160
CHUNK_TEXTS = 1024
CHUNK_CHARS = 2_000_000
MATRIX_COLUMNS = 4096


def banding(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, with which a pair at
    ``similarity`` shares some band with probability ``recall`` and ``most`` hashes suffice."""
    best = (1, 1)
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of a text's n-grams, ascending; none without words."""
    words = text.lower().split()
    return np.unique(shingle_hashes(hasher()(words), SHINGLE)) if words else np.zeros(0, np.uint64)


def _coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    return draw.integers(1, 2**32, count, dtype=np.uint64).astype(np.uint32) | np.uint32(1), draw.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32)


def band_hashes(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash for each band of the MinHash signature of a set."""
    a, b = _coefficients(bands * rows)
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    least = np.full(bands * rows, 2**32 - 1, dtype=np.uint32)
    for start in range(0, len(low), 2048):
        x = low[start : start + 2048]
        mixed = a[:, None] * x[None, :] + b[:, None]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        least = np.minimum(least, mixed.min(axis=1))
    table = least.reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        out = (out ^ table[:, k]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            keys, chars, buckets = [], [], []
            for text in part.column(2).to_pylist():
                words = text.lower().split()
                hashes = hasher()(words)
                keys.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                chars.append(len(text))
                buckets.append(band_hashes(np.unique(shingle_hashes(hashes, SHINGLE)), bands, rows).view(np.int64) if words else [])
            columns = [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(chars, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "words", "chars", "buckets"])


def _sizes(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([len(s) for s in sets], dtype=np.int64)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, over the values that occur in two sets at least."""
    n = len(sets)
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    shared = values[counts > 1]
    total = np.zeros((n, n), dtype=np.int64)
    owner = np.repeat(np.arange(n), _sizes(sets))
    flat = np.concatenate(sets)
    at = np.searchsorted(shared, flat)
    at[at == len(shared)] = 0
    hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
    owner, at = owner[hit], at[hit]
    for low in range(0, len(shared), MATRIX_COLUMNS):
        inside = (at >= low) & (at < low + MATRIX_COLUMNS)
        there = np.zeros((n, min(MATRIX_COLUMNS, len(shared) - low)), dtype=np.float32)
        there[owner[inside], at[inside] - low] = 1
        total += (there @ there.T).astype(np.int64)  # at most MATRIX_COLUMNS, so whole
    return total


def _tile(keys: list[int], sides: list[int], texts: list[str], similarity: float) -> tuple[list[int], list[int], list[int]]:
    """(keys, links of each, smallest key of its part) of the members that have a link."""
    sets = [shingles(t) for t in texts]
    common, sizes = common_counts(sets), _sizes(sets)
    # |A and B| / |A or B| >= p / q in whole numbers, so that pairs at the threshold are in
    least = Fraction(str(similarity)).limit_denominator(10**9)
    p, q = least.numerator, least.denominator
    linked = common * (p + q) >= p * (sizes[:, None] + sizes[None, :])
    side = np.array(sides)
    linked &= side[:, None] != side[None, :] if side.any() else ~np.eye(len(keys), dtype=bool)
    linked &= common > 0
    part = np.array(keys, dtype=np.int64)
    while True:  # the smallest key spreads over the links
        near = np.where(linked, part[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(part, near)
        if (new == part).all():
            break
        part = new
    links = linked.sum(axis=1)
    some = np.flatnonzero(links)
    return [keys[i] for i in some], links[some].tolist(), part[some].tolist()


def _tiles(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; a tile has the texts of one or two chunks."""
    tile, members = None, ([], [], [])
    out = ([], [], [])

    def close():
        if len(members[0]) > 1:
            for column, new in zip(out, _tile(*members, similarity)):
                column.extend(new)

    def batch_of():
        made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["key", "links", "root"])
        for column in out:
            column.clear()
        return made

    for batch in batches:
        for name, side, key, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if name != tile:
                close()
                tile, members = name, ([], [], [])
                if len(out[0]) > 10_000:
                    yield batch_of()
            for column, x in zip(members, (key, side, text)):
                column.append(x)
    close()
    yield batch_of()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each node's connected component, for all nodes of the edges.

    Each round hangs every node's larger neighbours, and then its smaller ones, under the smallest; a
    round is a group and a join, and is written. The number of rounds grows with the logarithm of a
    component's length."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    pairs = stored(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = stored(small.select("e.u", "e.v").filter("u <> v").distinct())
        facts = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 32))).alias("h")).first()
        if facts(new) == facts(pairs):
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        pairs = new


def signed(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_hash, words, chars, buckets) of every row, in the shared folder: a 128-bit hash
    of the text's words, and its band hashes (none without words). No shuffle."""
    bands, rows = banding(similarity, recall)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    made = plain.mapInArrow(lambda b: _signed(b, bands, rows), "doc_id long, text_hash long, words binary, chars long, buckets array<long>")
    return stored(made)


def _large_buckets(texts: DataFrame) -> DataFrame:
    """(key, bucket, members): a row for each bucket of two texts or more that a text is in."""
    keyed = texts.select("key", F.explode("buckets").alias("bucket"))
    # counted before the shuffle, so that a bucket of many texts is few rows
    large = keyed.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    return stored(keyed.join(large, "bucket").select("key", "bucket", "members"))


def _chunks(met: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, chunk): texts of one home go together, as many as a task can hold.

    A text's first home is its largest bucket. Near copies that miss that bucket would make many small homes, each
    to be compared with the large one; so each bucket then names the largest home of its texts, and each
    text takes the largest home that its buckets name."""
    first = met.groupBy("key").agg(F.max_by("bucket", F.struct("members", "bucket")).alias("home"))
    sized = first.join(first.groupBy("home").agg(F.count("*").alias("size")), "home")
    named = met.select("key", "bucket").join(sized, "key")
    best = named.groupBy("bucket").agg(F.max(F.struct("size", "home")).alias("best"))
    homes = met.select("key", "bucket").join(best, "bucket").groupBy("key").agg(F.max("best").alias("b")).select("key", F.col("b.home").alias("home"))
    homes = stored(homes.join(texts.select("key", "chars"), "key"))
    cuts = homes.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / CHUNK_TEXTS, F.sum("chars") / CHUNK_CHARS)).alias("cuts"))
    cut = F.pmod(F.xxhash64("key", F.lit(3)), F.col("cuts"))
    return stored(homes.join(cuts, "home").select("key", F.xxhash64("home", cut).alias("chunk")))


def links(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_hash, copy_id, class_id, n_links, n_copies) of every row."""
    rows = signed(docs, similarity, recall)
    # copy_id and text_hash are of one row, which stands for the class; rows without an id come last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    texts = rows.groupBy("words").agg(first, F.count("*").alias("n_copies"), F.max("chars").alias("chars"), F.first("buckets").alias("buckets"))
    # a class has a number of its own, which stays as it is written
    texts = stored(texts.select("words", F.monotonically_increasing_id().alias("key"), F.col("first.doc_id").alias("copy_id"), "n_copies", F.col("first.text_hash").alias("text_hash"), "chars", "buckets"))
    met = _large_buckets(texts)
    chunk_of = _chunks(met, texts)
    spans = met.select("key", "bucket").join(chunk_of, "key").groupBy("bucket", "chunk").agg(F.count("*").alias("n"))
    # a text alone in its chunk needs no tile of its own
    sizes = chunk_of.groupBy("chunk").agg(F.count("*").alias("size"))
    alone = sizes.filter("size > 1").select(F.col("chunk").alias("a"), F.col("chunk").alias("b"))
    across = spans.select("bucket", F.col("chunk").alias("a")).join(spans.select("bucket", F.col("chunk").alias("b")), "bucket").filter("a < b").select("a", "b").distinct()
    side = lambda c, n: F.struct(F.col(c).alias("chunk"), F.lit(n).alias("side"))
    sides = F.when(F.col("a") == F.col("b"), F.array(side("a", 0))).otherwise(F.array(side("a", 0), side("b", 1)))
    tiles = across.unionByName(alone).select(F.xxhash64("a", "b").alias("tile"), F.explode(sides).alias("s")).select("tile", "s.*")
    # the texts that take part, fetched by the row that stands for them
    wanted = chunk_of.join(texts.select("key", "copy_id", "text_hash"), "key")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    on = (F.col("hash") == F.col("text_hash")) & F.col("doc_id").eqNullSafe(F.col("copy_id"))
    members = plain.join(wanted, on).select("key", "chunk", "text").dropDuplicates(["key"])
    dealt = tiles.join(members, "chunk").select("tile", "side", "key", "text").repartition("tile").sortWithinPartitions("tile")
    linked = stored(dealt.mapInArrow(lambda b: _tiles(b, similarity), "key long, links long, root long"))
    groups = components(linked, "key", "root")
    counts = linked.groupBy(F.col("key").alias("k")).agg(F.sum("links").alias("n_links"))
    grouped = texts.select("key", "copy_id").join(groups, F.col("key") == F.col("node"), "right")
    heads = groups.select("root").distinct().join(texts.select(F.col("key").alias("root"), F.col("copy_id").alias("root_id")), "root")
    smallest = grouped.groupBy("root").agg(F.min("copy_id").alias("other_id")).join(heads, "root").select(F.col("root").alias("r"), F.least("other_id", "root_id").alias("class_id"))
    placed = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).join(smallest, F.col("root") == F.col("r")).select("node", "class_id")
    facts = texts.select("words", "key", "copy_id", "n_copies").join(placed, F.col("key") == F.col("node"), "left").join(counts, F.col("key") == F.col("k"), "left")
    facts = facts.select("words", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return rows.select("doc_id", "text_hash", "words").join(facts, "words").select("doc_id", "text_hash", "copy_id", "class_id", "n_links", "n_copies")


def first_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without all but the one of each group that has the smallest doc_id (one row, if
    rows repeat it), with their columns as they were. Rows without an id stay."""
    kept_id, kept_hash, rows = scratch_names(docs, "kept_id", "kept_hash", "rows")
    found = links(docs, similarity).filter("doc_id is null or doc_id = class_id or class_id is null")
    found = found.groupBy(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash)).agg(F.count("*").alias(rows))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.xxhash64(text) == F.col(kept_hash))
    repeated = (F.col(rows) > 1) & F.col(kept_id).isNotNull()
    again = docs.join(found.filter(repeated), on, "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(found.filter(~repeated), on, "left_semi").unionByName(again)
