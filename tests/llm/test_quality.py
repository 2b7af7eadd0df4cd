import math
import random
import tracemalloc
from collections import Counter
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from newsloom.llm import quality

ORDER = quality.ORDER


def symbols(text):
    table = quality.symbols()
    return [int(table[ord(c)]) for c in " " * (ORDER - 1) + text]


def brute_model(texts):
    """Interpolated modified Kneser-Ney over lists of symbols, by dictionaries."""
    levels = [Counter()]
    for t in texts:
        s = symbols(t)
        levels[0].update(tuple(s[i : i + ORDER]) for i in range(len(t)))
    while len(levels) < ORDER:
        levels.append(Counter(g[1:] for g in levels[-1]))
    cuts = [quality.discounts(Counter(c.values())) for c in levels]

    def p(gram, level):
        if level == ORDER:
            return 1 / quality.SYMBOLS
        counts, context = levels[level], gram[level:-1]
        here = {g: n for g, n in counts.items() if g[:-1] == context}
        total = sum(here.values())
        if not total:
            return p(gram, level + 1)
        cut = lambda n: cuts[level][min(n, 3) - 1] if n else 0
        own = here.get(gram[level:], 0)
        return (own - cut(own)) / total + sum(map(cut, here.values())) / total * p(gram, level + 1)

    return lambda gram: p(gram, 0)


def test_probabilities_and_perplexities(spark):
    draw = random.Random(2)
    good = ["".join(draw.choice("abc de,") for _ in range(40)) for _ in range(9)] + ["да и нет, да", "世界 世界"]
    other = ["abc dex", "ZZ##", "", None, "é a", "нет и да", "界世 x", "😀" * 9]
    rows = [(k, t, "en", 0) for k, t in enumerate(good + other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, block int").repartition(3)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(good))] + [(0, None, None), (None, 1, 0), (12, 0, 0), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.scores(docs, labels).collect()}
    assert not any(got[k]["held"] for k in range(len(good), len(rows)))
    p = brute_model([t for k, t in enumerate(good) if not got[k]["held"]])
    for k, t, *_ in rows:
        s, r = symbols(t or ""), got[k]
        want = -sum(math.log(p(tuple(s[i : i + ORDER]))) for i in range(len(t))) / len(t) if t else None
        assert r["chars"] == len(t or "")
        assert (r["log_ppl"] is None) if want is None else abs(r["log_ppl"] - want) < 3e-3


def test_one_text_in_eight_is_held_out_with_its_copies(spark):
    texts = [f"text {k // 2}" for k in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(800)], "doc_id long, quality int, toxic int")
    held = [r["doc_id"] for r in quality.scores(docs, labels).filter("held").collect()]
    assert 60 < len(held) < 140 and {k ^ 1 for k in held} == set(held)


def test_packed_arrays():
    draw = np.random.default_rng(5)
    for codes in (np.zeros(0, np.int64), np.unique(draw.integers(0, 1 << 60, 5000)), np.array([7])):
        assert (quality.unpack_grams(quality.pack_grams(codes)) == codes).all()
        order, ends = quality._by_shard(codes, 16)
        assert sorted(order.tolist()) == list(range(len(codes))) and ends[-1] == len(codes)
    codes, counts = quality.merged(np.array([5, 3, 5, 9]), np.array([1, 2, 3, 4]))
    assert codes.tolist() == [3, 5, 9] and counts.tolist() == [2, 4, 4]


def test_limit_is_the_far_quantile_of_held_out_texts(spark):
    draw = random.Random(8)
    rows = [(k, x, k % 3 > 0, 1000 + k, (1.3 if x == "en" else 2.0) + draw.gauss(0, 0.05)) for k in range(600) for x in ("en", "de", None)] + [(9, "fr", True, 50, 1.0), (8, "en", True, 0, None)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, held boolean, chars long, log_ppl double")
    got = {(r["every"], r["lang"]): (r["median"], r["high"]) for r in quality.limits(scored).collect()}
    assert set(got) == {(False, "en"), (False, "de"), (False, None), (True, None)}
    for every, lang in got:
        of = [(n, p) for _, x, held, n, p in rows if held and p is not None and (every or x == lang)]
        median = sorted(p for _, p in of)[(len(of) + 1) // 2 - 1]
        judged = sorted((p * n + median * quality.PRIOR_CHARS) / (n + quality.PRIOR_CHARS) for n, p in of)
        mid, high = judged[(len(of) + 1) // 2 - 1], judged[math.ceil(0.75 * len(of)) - 1]
        want = mid + NormalDist().inv_cdf(1 - quality.TAIL) / NormalDist().inv_cdf(0.75) * (high - mid)
        assert abs(got[every, lang][0] - median) < 1e-9 and abs(got[every, lang][1] - want) < 1e-9


def corpus(spark):
    draw = random.Random(3)
    latin = ["river", "stone", "market", "window", "garden", "letter", "winter", "music"]
    other = ["река", "камень", "рынок", "окно", "сад", "письмо", "зима", "музыка"]
    clean = [(k, " ".join(draw.choices(latin if k % 2 else other, k=40)) + ".", "en" if k % 2 else "ru") for k in range(480)]
    junk = [(1000 + k, "".join(draw.choice("#$%&*@XQZ") for _ in range(600)), "en") for k in range(5)]
    junk += [(1010 + k, "".join(draw.sample("".join(other), 30)) * 20, "ru") for k in range(5)]
    odd = [(1300, None, "en"), (1301, "", None), (1302, "river stone", None), (1303, "river", "fr"), (None, clean[3][1], "en"), (1, clean[1][1], "en")]
    docs = spark.createDataFrame([(i, t, x, "s", 1, "c") for i, t, x in clean + junk + odd], "doc_id long, text string, lang string, source string, n_chars long, keep string")
    return docs, spark.createDataFrame([(k, 1, 0) for k in range(480)], "doc_id long, quality int, toxic int")


def test_junk_goes_and_clean_stays(spark):
    """By language: each has its script, so that the others' classes of characters are tested too."""
    docs, labels = corpus(spark)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert not set(range(1000, 1020)) & set(ids) and set(range(480)) | {None, 1300, 1301, 1302, 1303} <= set(ids) and ids.count(1) == 2
    judged = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert judged[1303]["limit"] == judged[1302]["limit"] != judged[1]["limit"]  # of all languages


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark)
    assert quality.keep(docs, labels.limit(0)).count() == docs.count()
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_clashing_columns(spark):
    docs, labels = corpus(spark)
    names = ["bad_id", "bad_hash", "text_hash", "block", "perplexity", "limit", "good", "limit_lang", "total"]
    more = docs.select("*", *[F.lit(n).alias(n) for n in names])
    kept = quality.keep(more, labels)
    assert kept.columns == more.columns and kept.count() == quality.keep(docs, labels).count()
    assert {tuple(r) for r in kept.select(*names).collect()} == {tuple(names)}


def test_a_language_needs_so_many_held_out_texts(spark):
    """With one text too few a language has no limit of its own; with just as many it has."""
    of = {"few": quality.LEAST_HELD - 1, "enough": quality.LEAST_HELD}
    rows = [(k, lang, True, 1000, 1.0 + k / 100) for lang, n in of.items() for k in range(n)]
    scored = spark.createDataFrame(rows, "doc_id long, lang string, held boolean, chars long, log_ppl double")
    assert {(r["every"], r["lang"]) for r in quality.limits(scored).collect()} == {(False, "enough"), (True, None)}
    assert quality.limits(scored.filter("lang = 'few'")).count() == 0


def peak(job):
    """(what ``job`` returns, MB that it held at most besides Arrow's)."""
    tracemalloc.start()
    try:
        return job(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def packed_block(rows):
    """A block of ``rows`` rows of two texts with the same n-grams."""
    draw = random.Random(4)
    texts = ["".join(draw.choice("ab ") for _ in range(n)) for n in (100_000, 150_000)]
    raw = zstandard.compress("".join(texts).encode(), 3)
    columns = [[0] * rows, [[2 * k, None] for k in range(rows)], [[7, 8]] * rows, [["en", None]] * rows, [[0, 1]] * rows, [[len(t) for t in texts]] * rows, [raw] * rows]
    kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
    return texts, pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in quality.BLOCK.split(", ")])


def test_memory_of_a_block_is_that_of_one_part():
    """Twelve times the texts with the same n-grams need no more memory, neither to ask nor to score."""
    (texts, small), (_, large) = packed_block(2), packed_block(24)
    asked, few = peak(lambda: quality._asked(small, 16))
    again, many = peak(lambda: quality._asked(large, 16))
    assert again.equals(asked) and many < 1.3 * few
    codes = np.concatenate([quality.unpack_grams(x) for x in asked["grams"].to_pylist()])
    assert sorted(codes.tolist()) == sorted(set(quality.grams(texts)[0].tolist()))
    logs = lambda c: -(c % 7 + 1).astype(np.float16)
    raw = [zstandard.compress(np.ascontiguousarray(logs(quality.unpack_grams(x))[:, None].view(np.uint8).T).tobytes()) for x in asked["grams"].to_pylist()]
    answers = pa.table({"block": pa.array([0] * len(raw), pa.int32()), "grams": asked["grams"], "logs": pa.array(raw, pa.binary())})
    few = peak(lambda: quality._scores(small, answers))[1]
    got, many = peak(lambda: quality._scores(large, answers))
    assert many < 1.3 * few
    totals = [float(logs(quality.grams([t])[0]).astype(np.float64).sum()) for t in texts]
    assert got["total"].to_pylist() == totals * 24 and got["chars"].to_pylist() == [100_000, 150_000] * 24
    assert got["doc_id"].to_pylist() == [x for k in range(24) for x in (2 * k, None)] and got["lang"].to_pylist() == ["en", None] * 24
    assert got["good"].to_pylist() == [0, 1] * 24 and got["text_hash"].to_pylist() == [7, 8] * 24


def test_counts_are_added_as_merged_ones():
    draw = np.random.default_rng(6)
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for top in (0, 50, 50, 5000, 1 << 60):
        new, times = np.unique(draw.integers(0, top + 1, 400 if top else 0), return_counts=True)
        want = quality.merged(np.concatenate([codes, new]), np.concatenate([counts, times]))
        codes, counts = quality._added(codes, counts, new, times)
        assert codes.tolist() == want[0].tolist() and counts.tolist() == want[1].tolist()
    pairs = [(int(c) >> quality.SYMBOL_BITS) % quality.SYMBOLS**2 for c in codes]
    assert quality.shard_of(codes, 4096).tolist() == [(p * 0x9E3779B97F4A7C15 % 2**64 >> 33) % 4096 for p in pairs]
