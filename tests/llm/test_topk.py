import math
import random

from pyspark.sql import functions as F

from newsloom.llm import topk


def brute(rows, k=5):
    usable = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in usable:
        if i is not None and i % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, j, v in usable if m != n and len(v) == len(q))[:k]
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(found, 1)]
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int").repartition(3)
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, **more).collect()), key=str)


def vectors(n, dim, seed, step=8):
    draw = random.Random(seed)
    return [(k, [draw.randint(-40, 40) / step / 10 for _ in range(dim)]) for k in range(n)]


def test_against_all_scores(spark):
    rows = vectors(700, 12, 1)
    rows = [(i, [float.fromhex(x.hex()) for x in v]) for i, v in rows]
    exact = [(i, [struct_float(x) for x in v]) for i, v in rows]
    assert run(spark, exact) == brute(exact)
    assert run(spark, exact, wave=3) == brute(exact)


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_ties_nulls_and_repeats(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (50, [1.0, 0.5]), (7, [1.0, 0.5]), (3, [1.0, 0.5]), (None, [1.0, 0.5]), (100, None), (150, [None, 1.0]), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (300, [0.0, 0.0]), (350, [-1.0, -3.0]), (400, [1.0]), (450, [])]
    assert run(spark, rows) == brute(rows)


def test_large_components_and_empty_tables(spark):
    rows = [(k * 25, [1000.0 * ((k * 37) % 11 - 5), 0.25 * k]) for k in range(40)]
    assert run(spark, rows) == brute(rows)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_few_exact_vectors_are_read(spark, monkeypatch):
    """Components far wider than a cell: bounds decide, and most exact vectors stay unread."""
    counts, real = [], topk.read_in_order
    monkeypatch.setattr(topk, "read_in_order", lambda *a: counts.append(real(*a)) or counts[-1])
    draw = random.Random(2)
    centres = [[draw.gauss(0, 30) for _ in range(24)] for _ in range(40)]
    rows = [(k, [struct_float(x + draw.gauss(0, 3)) for x in centres[k % 40]]) for k in range(4000)]
    assert run(spark, rows) == brute(rows)
    n_queries = 80
    read = sum(df.count() for df in counts)
    assert 5 * n_queries <= read < n_queries * len(rows) / 20


def test_one_very_common_vector(spark):
    """Copies are one entry, so bounds between copies are never listed."""
    rows = [(k, [9.0, -4.0, 2.5] if k % 3 else [k / 64, 1.0, -k / 128]) for k in range(900)]
    assert run(spark, rows) == brute(rows)
    file = topk.approximation_file(topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), F.col("vec_id") % 50 == 0, 6, 3)
    assert file.count() == 301 and max(len(r["members"]) for r in file.collect()) == 6


def test_one_large_component_widens_no_other_cell(spark, monkeypatch):
    """The bounds that tiles list are counted, with and without one component far above all others."""
    counts, real = [], topk.bounded_scores
    monkeypatch.setattr(topk, "bounded_scores", lambda *a: counts.append(real(*a)) or counts[-1])
    draw = random.Random(4)
    rows = [(k, [struct_float(draw.gauss(0, 1)) for _ in range(24)]) for k in range(4000)]
    for large in (None, 1e7):
        if large:
            rows[77][1][5] = large
            rows[100][1][7] = -large
        assert run(spark, rows) == brute(rows)
        assert counts.pop().count() < 80 * len(rows) / 20


def test_blocks_and_rounds(spark):
    rows = [(k * 10, [struct_float(math.sin(k * j)) for j in range(1, 7)]) for k in range(300)]
    assert run(spark, rows, wave=7, at_once=2) == run(spark, rows) == brute(rows)


def test_jobs_do_not_grow_with_queries(spark, monkeypatch):
    """Many blocks are tiles of one job."""
    writes, real = [], topk.stored
    monkeypatch.setattr(topk, "stored", lambda df: writes.append(1) or real(df))
    rows = [(k * 50, [struct_float(math.sin(k * j)) for j in range(1, 5)]) for k in range(400)]
    one = run(spark, rows)
    few, writes[:] = len(writes), []
    assert run(spark, rows, wave=10) == one and len(writes) == few


def test_cells_cover_all_values():
    import numpy as np

    draw = np.random.default_rng(3)
    for x in (draw.standard_cauchy(5000) * 1e6, draw.normal(0, 50, 3000), np.array([7.0]), np.array([0.0, 0.0, 5e15, -5e15]), draw.integers(-3, 4, 900)):
        x = np.floor(x).astype(np.int64)
        counted = topk._joined_bins(topk.pd.DataFrame({"position": 0, "bin": topk.bins(x, topk.DETAIL), "n": 1, "low": x, "high": x}))
        assert (counted["low"].to_numpy()[1:] > counted["high"].to_numpy()[:-1]).all()
        first, last = topk.cells_of(*(counted[c].to_numpy() for c in ("n", "low", "high")))
        at = np.searchsorted(first, x, side="right") - 1
        assert len(first) <= topk.CELLS and (first[at] <= x).all() and (x <= last[at]).all() and (last[:-1] < first[1:]).all()


def test_scores_above_exact_doubles(spark):
    rows = [(k * 25, [2.0**20 * (k % 7) + k, 2.0**21 - 3.0 * k, 1.0]) for k in range(60)]
    assert run(spark, rows) == brute(rows)
