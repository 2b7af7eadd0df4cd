"""Operator 6: document fingerprints by SimHash.

Terms are the five-word shingles of a text and, with less weight, its words; a term counts with the
square root of its frequency in the whole text, in whole hundredths. Each term's hash votes with its weight on
every bit of the fingerprint, for by a one and against by a zero, and the sign of the sum is the bit. Sums are
of whole numbers, so they don't depend on the order or on how a long text is taken in parts.

``neighbours`` finds all different fingerprints within a Hamming radius: the bits are cut into radius +
``agree`` blocks; two fingerprints that differ in at most radius bits agree in ``agree`` blocks at least, so for each
choice of so many blocks there is a table keyed by them (the fingerprint permuted to put those first). ``agree`` is the
least with which a key has few fingerprints by chance; it changes work, not results.
Equal fingerprints are one row of the tables, whatever the number of their documents. A key with many
fingerprints is cut into chunks, and each pair of chunks is a tile of bounded size, in which all distances are
counted at once; pairs are summed up for each fingerprint and never listed.

``with_edits`` deals documents into ranges of doc_id and streams each range with one document held; the
last document of a range meets the first of the next in a small join of the ranges' edges.

Defined results: null text counts as empty; a text without words has the fingerprint of zeros, and a sum of exactly
zero gives a zero bit; equal texts have equal fingerprints; a text of fewer than five words is one shingle; repeated rows
have a row each; the document after the last is the first, so that a single document is its own next one;
documents are ordered by doc_id (null first), then text; an empty table gives no rows; other columns are ignored.
``n_near`` counts all other rows, copies included, whose fingerprint is within the radius; ``near_id`` is the smallest
doc_id among those and the document's own copies (null ids count, but are no smallest).
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.support import stored

BITS = 128
SHINGLE = 5
SHINGLE_WEIGHT, WORD_WEIGHT = 100, 35
CACHED_WORDS = 300_000
RADIUS = 5
BY_CHANCE = 64
CHUNK = 1024
PART = 1 << 14
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGE = "kind string, part int, text string"
NO_ID = 2**63 - 1


class Hasher:
    """64-bit hashes of words, with a bounded cache."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


@lru_cache(1)
def hasher() -> Hasher:
    return Hasher()


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``size`` words; one of all words where there are fewer."""
    n = max(1, len(hashes) - size + 1)
    out = np.full(n, len(hashes) if len(hashes) < size else size, dtype=np.uint64)
    for k in range(min(size, len(hashes))):
        out += (hashes[k : k + n] ^ np.uint64(k + 1)) * np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return _mixed(out, 0)


def _counted(values: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Different terms and their weights."""
    terms, counts = np.unique(values, return_counts=True)
    return terms, np.rint(np.sqrt(counts) * weight)


def _votes(terms: np.ndarray, weights: np.ndarray, bits: int) -> np.ndarray:
    voters = np.empty((len(terms), bits // 64), dtype=np.uint64)
    for k in range(bits // 64):
        voters[:, k] = _mixed(terms, 101 + k)
    ones = np.unpackbits(voters.view(np.uint8), axis=1, bitorder="little")
    # whole sums are exact below 2**24 in single precision, and far beyond in double
    kind = np.float32 if weights.sum() < 1 << 24 else np.float64
    return 2 * (weights.astype(kind) @ ones.astype(kind)).astype(np.float64) - weights.sum()


def fingerprint(text: str, bits: int = BITS) -> bytes:
    words = text.split()
    if not words:
        return bytes(bits // 8)
    hashes = hasher()(words)
    both = zip(_counted(shingle_hashes(hashes), SHINGLE_WEIGHT), _counted(hashes, WORD_WEIGHT))
    terms, weights = (np.concatenate(x) for x in both)
    total = sum(_votes(terms[low : low + PART], weights[low : low + PART], bits) for low in range(0, len(terms), PART))
    return np.packbits(total > 0, bitorder="little").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal bits."""
    return 1 - (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count() / (8 * len(a))


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the next one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _fingerprints(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [fingerprint(t or "", bits).hex() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint in hex) of every row, without a shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _fingerprints(b, bits), "doc_id long, fingerprint string")


def block_choices(count: int, radius: int = RADIUS, bits: int = BITS) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """(first bit and width of each block, the choices of blocks that make the tables' keys)."""
    agree = 1
    while count >> (agree * bits // (radius + agree)) > BY_CHANCE and radius + agree + 1 <= bits:
        agree += 1
    cuts = [k * bits // (radius + agree) for k in range(radius + agree + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])], list(itertools.combinations(range(radius + agree), agree))


def _block_key(halves: list[Column], spans: list[tuple[int, int]]) -> Column:
    """A 64-bit key of some blocks of a fingerprint; distances are verified, so equal keys of different blocks do no harm."""
    pieces = []
    for first, width in spans:
        while width:
            half, at = divmod(first, 64)
            size = min(width, 64 - at, 32)
            pieces.append(F.shiftrightunsigned(halves[half], at).bitwiseAND((1 << size) - 1))
            first, width = first + size, width - size
    return F.xxhash64(*pieces)


def _tile(marks: np.ndarray, rows: np.ndarray, ids: np.ndarray, sides: np.ndarray, table: int, spans, tables, radius: int) -> list[tuple]:
    """(mark as two halves, rows near, smallest id near) of the fingerprints of one tile that have neighbours.
    A pair counts only in the first table whose blocks agree."""
    words = marks.view(np.uint64).reshape(len(marks), -1)
    left, right = (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)) if sides.any() else (np.arange(len(marks)),) * 2
    x = words[left][:, None, :] ^ words[right][None, :, :]
    near = np.bitwise_count(x).sum(axis=2, dtype=np.int32) <= radius
    if left is right:
        np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    if not len(a):
        return []
    differ = np.unpackbits(np.ascontiguousarray(x[a, b]).view(np.uint8), axis=1, bitorder="little")
    equal = np.stack([~differ[:, first : first + width].any(axis=1) for first, width in spans], axis=1)
    firsts = np.stack([equal[:, list(t)].all(axis=1) for t in tables], axis=1).argmax(axis=1)
    a, b = left[a[firsts == table]], right[b[firsts == table]]
    if left is not right:
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
    count, least = np.zeros(len(marks), np.int64), np.full(len(marks), NO_ID)
    np.add.at(count, a, rows[b])
    np.minimum.at(least, a, ids[b])
    some = np.flatnonzero(count)
    halves = words[some].view(np.int64)
    return list(zip(*halves.T.tolist(), count[some].tolist(), least[some].tolist()))


def _tiles(batches: Iterator[pa.RecordBatch], spans, tables, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; a tile has fingerprints of one or two chunks of one key."""
    halves = len(half_names(spans))
    key, waiting, out = None, [], []

    def close():
        if len(waiting) > 1:
            columns = list(zip(*waiting))
            marks = np.array(columns[:halves], dtype=np.int64).T.copy()
            out.extend(_tile(marks, *(np.array(c) for c in columns[halves:]), key[0], spans, tables, radius))

    def made():
        columns = list(zip(*out)) or [[]] * (halves + 2)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*half_names(spans), "rows", "least"])

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for tile, *row in zip(zip(*columns[:2]), *columns[2:]):
            if tile != key:
                close()
                key, waiting = tile, []
                if len(out) > 10_000:
                    yield made()
            waiting.append(row)
    close()
    yield made()


def half_names(spans) -> list[str]:
    """Columns of a fingerprint's 64-bit halves."""
    return [f"mark{k}" for k in range(sum(width for _, width in spans) // 64)]


def neighbours(marked: DataFrame, radius: int = RADIUS, bits: int = BITS, choices=None) -> DataFrame:
    """(fingerprint, n_near, near_id) of the different fingerprints of ``marked`` (doc_id, fingerprint) that have others
    at most ``radius`` bits apart: the rows of those, and their smallest doc_id. ``choices`` are blocks and tables."""
    known = marked.filter(F.col("fingerprint").isNotNull())
    distinct = stored(known.groupBy("fingerprint").agg(F.count("*").alias("rows"), F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("least")))
    spans, tables = choices or block_choices(distinct.count(), radius, bits)
    names = half_names(spans)
    # hexadecimal digits are of little-endian bytes
    half = lambda k: F.conv(F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0)), lambda i: F.substring("fingerprint", 16 * k + 2 * i + 1, F.lit(2))), ""), 16, -10).cast("long")
    halves = distinct.select(*[half(k).alias(n) for k, n in enumerate(names)], "rows", "least")
    keys = F.array(*[F.struct(F.lit(k).alias("table"), _block_key([F.col(n) for n in names], [spans[i] for i in t]).alias("block")) for k, t in enumerate(tables)])
    keyed = halves.select(*names, "rows", "least", F.explode(keys).alias("k")).select("k.*", *names, "rows", "least")
    # counted before the shuffle, so that a key of many fingerprints is few rows
    large = keyed.groupBy("table", "block").agg(F.count("*").alias("size")).filter("size > 1")
    met = keyed.join(large, ["table", "block"]).withColumn("cuts", F.ceil(F.col("size") / CHUNK))
    met = met.withColumn("chunk", F.pmod(F.xxhash64(*names), F.col("cuts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    tiled = met.withColumn("other", other).select("table", F.xxhash64("table", "block", low, high).alias("tile"), *names, "rows", "least", (F.col("chunk") > F.col("other")).cast("int").alias("side"))
    dealt = tiled.repartition("tile").sortWithinPartitions("table", "tile")
    made = dealt.mapInArrow(lambda b: _tiles(b, spans, tables, radius), ", ".join(f"{n} long" for n in [*names, "rows", "least"]))
    found = made.groupBy(*names).agg(F.sum("rows").alias("n_near"), F.min("least").alias("near_id"))
    back = lambda n: F.lower(F.lpad(F.hex(n), 16, "0"))
    little = lambda n: F.array_join(F.transform(F.sequence(F.lit(7), F.lit(0)), lambda i: F.substring(back(n), 2 * i + 1, F.lit(2))), "")
    return found.select(F.concat(*[little(n) for n in names]).alias("fingerprint"), "n_near", F.when(F.col("near_id") != NO_ID, F.col("near_id")).alias("near_id"))


def with_neighbours(made: DataFrame, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """The rows of ``with_edits`` with n_near and near_id."""
    copies = made.groupBy("fingerprint").agg(F.count("*").alias("own"), F.min("doc_id").alias("own_id"))
    near = copies.join(neighbours(made.select("doc_id", "fingerprint"), radius, bits), "fingerprint", "left")
    facts = near.select(F.col("fingerprint").alias("of"), (F.col("own") - 1 + F.coalesce("n_near", F.lit(0))).alias("n_near"), F.least("own_id", "near_id").alias("near_id")).filter("n_near > 0")
    both = made.join(facts, F.col("fingerprint") == F.col("of"), "left").drop("of")
    return both.withColumns({"n_near": F.coalesce("n_near", F.lit(0)).cast("long"), "near_id": F.coalesce("near_id", "doc_id")})


def _row(own: tuple, following: str, mark: bytes, bits: int) -> tuple:
    doc_id, text, own_mark = own
    changed = edited(text, following)
    changed_mark = fingerprint(changed, bits) if changed != text else own_mark
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return doc_id, len(text), digest, own_mark.hex(), changed_mark.hex(), likeness(own_mark, changed_mark), likeness(own_mark, mark)


def _batch(rows: list[tuple], columns: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in columns.split(", ")))
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    values = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for v, k in zip(values, kinds)], names=list(names))


def _within_ranges(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    part, waiting = TaskContext.get().partitionId(), None
    edge = lambda own, kind: (own[0], None, None, own[2].hex(), None, None, None, kind, part, own[1])
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = doc_id, text, fingerprint(text, bits)
            rows.append((*_row(waiting, text, own[2], bits), "done", part, None) if waiting else edge(own, "first"))
            waiting = own
        yield _batch(rows, f"{EDITED}, {EDGE}")
    if waiting:
        yield _batch([edge(waiting, "last")], f"{EDITED}, {EDGE}")


def _across_ranges(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, following = list(zip(*(batch.column(k).to_pylist() for k in range(3)))), zip(*(batch.column(k).to_pylist() for k in (3, 4)))
        yield _batch([_row((i, t, bytes.fromhex(m)), text, bytes.fromhex(mark), bits) for (i, t, m), (text, mark) in zip(own, following)], EDITED)


def with_edits(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how alike they and the next document are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = stored(ranges.mapInArrow(lambda b: _within_ranges(b, bits), f"{EDITED}, {EDGE}"))
    names = [x.split()[0] for x in EDITED.split(", ")]
    # the edges are two rows for each range
    firsts = made.filter("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    turn = Window.orderBy("next_part")
    ring = firsts.select("next_part", F.lag("next_part").over(turn).alias("before"), F.max("next_part").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"))
    ring = ring.select("next_part", F.coalesce("before", "end").alias("part"))
    lasts = made.filter("kind = 'last'").select("doc_id", "text", "fingerprint", "part")
    edges = lasts.join(ring, "part").join(firsts, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_mark")
    return made.filter("kind = 'done'").select(*names).unionByName(edges.mapInArrow(lambda b: _across_ranges(b, bits), EDITED))
