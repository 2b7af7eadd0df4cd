import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import simhash


def test_fingerprints_of_edited_texts(spark):
    draw = random.Random(8)
    texts = [" ".join(draw.choices([f"w{k}" for k in range(300)], k=draw.choice([1, 4, 30, 500]))) for _ in range(60)] + ["", "", "é", "ab", "long " * 40_000]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t or None, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = {r["doc_id"]: r for r in simhash.with_edits(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edit = t[: len(t) - half] + following[:half]
        a, b, c = simhash.fingerprint(t), simhash.fingerprint(edit), simhash.fingerprint(following)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edit.encode()).hexdigest(), a.hex(), b.hex())
        assert r["near_edited"] == simhash.likeness(a, b) and r["near_next"] == simhash.likeness(a, c)


def test_few_rows(spark):
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert [(r["doc_id"], r["edited_sha256"]) for r in simhash.with_edits(one).collect()] == [(5, hashlib.sha256(b"abab").hexdigest())]
    assert simhash.with_edits(one.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "b"), (2, "a"), (2, "a"), (None, None)], "doc_id long, text string")
    assert simhash.with_edits(same).count() == 4


def plain(text):
    """Bit by bit, with dictionaries."""
    words = text.split()
    if not words:
        return bytes(16)
    grams = [words[i : i + 5] for i in range(max(1, len(words) - 4))]
    total = [0] * 128
    for terms, weight in ((Counter(int(simhash.shingle_hashes(simhash.hasher()(g))[0]) for g in grams), 100), (Counter(simhash.hasher()(words).tolist()), 35)):
        for term, n in terms.items():
            w = round(math.sqrt(n) * weight)
            for half in range(2):
                h = int(simhash._mixed(np.array([term], dtype=np.uint64), 101 + half)[0])
                for bit in range(64):
                    total[64 * half + bit] += w if h >> bit & 1 else -w
    return sum((t > 0) << k for k, t in enumerate(total)).to_bytes(16, "little")


@pytest.mark.parametrize("size, kinds", [(0, 1), (1, 5), (3, 5), (5, 5), (90, 20), (33_000, 200), (100_000, 60)])
def test_one_weighting_for_texts_of_any_length(size, kinds):
    draw = random.Random(size)
    chain = draw.choices([f"w{k}" for k in range(kinds)], k=max(1, min(size, 500)))
    text = " ".join(chain[k % len(chain)] if k % 97 else draw.choice(chain) for k in range(size))
    assert simhash.fingerprint(text) == plain(text)


def near(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


@pytest.mark.parametrize("count", [100, 10**9, 10**14])
def test_all_neighbours_within_the_radius(spark, count, monkeypatch):
    """With the tables that so many fingerprints take, and with chunks far smaller than the largest family."""
    monkeypatch.setattr(simhash, "CHUNK", 8)
    draw = random.Random(1)
    marks = [draw.getrandbits(128) for _ in range(40)]
    for m in marks[:20] + [marks[0]] * 12:
        for _ in range(4):
            x = m
            for bit in draw.sample(range(128), draw.randint(0, 7)):
                x ^= 1 << bit
            marks.append(x)
    marks += [0, 1, 2**128 - 1]
    text = lambda m: m.to_bytes(16, "little").hex()
    rows = [(k, text(m)) for k, m in enumerate(marks)] + [(999, None), (None, text(marks[1])), (None, text(1 << 127))]
    marked = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    got = {r["fingerprint"]: (r["n_near"], r["near_id"]) for r in simhash.neighbours(marked, choices=simhash.block_choices(count)).collect()}
    want = {}
    for f in {f for _, f in rows if f}:
        others = [i for i, g in rows if g and g != f and near(f, g) <= simhash.RADIUS]
        if others:
            want[f] = len(others), min((i for i in others if i is not None), default=None)
    assert len(want) > 60 and max(n for n, _ in want.values()) > 30 and got == want


def test_neighbours_of_documents(spark):
    draw = random.Random(4)
    words = [f"w{k}" for k in range(500)]
    texts = [" ".join(draw.choices(words, k=400)) for _ in range(12)]
    texts += [t.replace(" ", "  ", 1) for t in texts[:4]] + [" ".join(t.split()[:-1]) for t in texts[2:8]] + [None, "", "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.with_neighbours(simhash.with_edits(docs)).collect()
    assert len(got) == len(texts)
    marks = {k: simhash.fingerprint(t or "").hex() for k, t in enumerate(texts)}
    for r in got:
        others = [k for k, m in marks.items() if near(m, marks[r["doc_id"]]) <= simhash.RADIUS]
        assert (r["n_near"], r["near_id"]) == (len(others) - 1, min(others))
    assert sum(r["n_near"] > 0 for r in got) >= 10
    empty = simhash.with_edits(docs.limit(0))
    assert simhash.with_neighbours(empty).count() == 0


def test_likeness_follows_the_edit():
    draw = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    text = draw.choices(words, k=400)
    near, far = text[:380] + draw.choices(words, k=20), draw.choices(words, k=400)
    f = lambda w: simhash.fingerprint(" ".join(w))
    assert simhash.likeness(f(text), f(near)) > 0.85 > 0.65 > simhash.likeness(f(text), f(far))
