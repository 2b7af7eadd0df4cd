import math
import random
import re

import numpy as np

from newsloom.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(items, docs, k):
    """All pairs, by the words of the contract."""
    texts = [(d, words(t)) for d, t in docs]
    n_docs, all_terms = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    df = {}
    for _, w in texts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for d, w in texts:
            score = 0
            for t in set(words(text)) & set(w):
                tf, m = w.count(t), 100 - 50 + (50 * len(w) * n_docs) // all_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(spark, items, docs, k, **more):
    left = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int").repartition(2)
    right = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    return sorted(map(tuple, search.search(left, right, k, **more).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def fixture(n=500, seed=6):
    draw = random.Random(seed)
    bags = [[f"{c}{k}" for k in range(120)] for c in "aéж"]
    text = lambda size: " ".join(w.upper() if draw.random() < 0.1 else w for w in draw.choices(draw.choice(bags), weights=[1 / (k + 1) for k in range(120)], k=size))
    docs = [(k, text(draw.choice([1, 5, 20, 80, 400]))) for k in range(n)]
    docs += [(n + k, docs[7][1]) for k in range(60)] + [(None, docs[7][1]), (None, None), (n + 70, ""), (n + 71, "-- !?"), (3, docs[3][1]), (n + 72, docs[9][1] * 300)]
    items = [(k, text(draw.choice([2, 8, 30]))) for k in range(40)] + [(100, docs[7][1]), (101, None), (102, "unheard of"), (None, docs[9][1]), (5, docs[9][1])]
    return items, docs


def test_against_all_pairs(spark, monkeypatch):
    items, docs = fixture()
    monkeypatch.setattr(search, "BLOCK_DOCS", 100)
    monkeypatch.setattr(search, "BLOCK_VALUES", 700)
    monkeypatch.setattr(search, "PILOT", 3)
    for k in (1, 10):
        want = brute(items, docs, k)
        assert got(spark, items, docs, k) == want
    monkeypatch.setattr(search, "ITEM_CHARS", 900)  # several sets of items
    assert got(spark, items, docs, 10) == want


def test_few_pairs_are_scored():
    """Batches are left out: most pairs of items and documents are never scored."""
    draw = random.Random(8)
    topics = [[f"t{c}w{k}" for k in range(30)] for c in range(60)]
    text = lambda c, n: " ".join(draw.choices(topics[c], k=n))
    docs = [words(text(draw.randrange(60), 40)) for _ in range(6000)]
    items = search.Items([(c, text(c, 12)) for c in range(60)])
    vocabulary, counts = items.vocabulary, {}
    rows = [np.unique([vocabulary[w.encode()] for w in d if w.encode() in vocabulary], return_counts=True) for d in docs]
    for own, _ in rows:
        for t in own:
            counts[int(t)] = counts.get(int(t), 0) + 1
    items.weigh(len(docs), counts)
    found = search.Search(items, 5, np.zeros(60, np.int64))
    ptr = np.cumsum([0, *(len(own) for own, _ in rows)])
    tf = np.concatenate([n for _, n in rows])
    found.block(np.arange(6000), np.zeros(6000, np.int64), ptr, np.concatenate([own for own, _ in rows]), search.impacts(tf, np.full(len(tf), 100)))
    assert sum(len(s) for s, _, _ in found.best) == 300
    assert found.scored < 60 * 6000 / 20


def test_hierarchy_holds_the_maxima():
    draw = np.random.default_rng(2)
    sizes = draw.integers(0, 6, 300)
    ptr = np.cumsum(np.append(0, sizes))
    columns = np.concatenate([np.sort(draw.choice(20, s, replace=False)) for s in sizes])
    values = draw.integers(1, 1000, len(columns))
    tree = search.Hierarchy(ptr, columns, values, 4)
    assert sorted(tree.order) == list(range(300))
    for node in range(len(tree.low)):
        best = {}
        for row in tree.order[tree.low[node] : tree.high[node]]:
            for c, v in zip(columns[ptr[row] : ptr[row + 1]], values[ptr[row] : ptr[row + 1]]):
                best[c] = max(best.get(c, 0), v)
        assert dict(zip(tree.terms[node], tree.maxima[node])) == best
        if tree.left[node] >= 0:
            assert (tree.low[tree.left[node]], tree.high[tree.right[node]]) == (tree.low[node], tree.high[node]) and tree.high[tree.left[node]] == tree.low[tree.right[node]]
        else:
            assert tree.high[node] - tree.low[node] <= 4


def test_empty_tables(spark):
    items, docs = [(1, "a b")], [(1, "a b")]
    assert got(spark, items, docs, 5) == brute(items, docs, 5) != []
    assert got(spark, items, docs[:0], 5) == got(spark, items[:0], docs, 5) == got(spark, [(1, None)], docs, 5) == got(spark, items, [(1, None)], 5) == []
