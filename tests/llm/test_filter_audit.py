import random
from collections import defaultdict
from itertools import permutations

import numpy as np

from newsloom.llm import filter_audit


def fails(rows):
    """The filters that each row fails, by the words of the contract."""
    out = []
    for doc_id, text, _ in rows:
        text, words = text or "", []
        for line in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" "):
            words += [line] if line else []
        twin = doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows)
        tests = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text), twin]
        out.append({f for f, bad in zip("ABCDE", tests) if bad})
    return out


def brute(rows, labels):
    """Each order applied to each part, row by row."""
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for row, f in zip(rows, fails(rows)):
        parts[row[2] or ""].append((row[0], f))
    out = {}
    for part, docs in parts.items():
        total = defaultdict(int)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone, stay = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                total[f] += len(gone)
                lost = [sum(d in said for d, _ in gone) for said in (good, toxic)]
                out[part, "".join(order), step] = [len(stay), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == {f} for d in docs), *lost]
                left = stay
        for key in out:
            if key[0] == part:
                out[key] = out[key][:6] + [total[key[1][key[2] - 1]]]
    return out


def fixture():
    draw = random.Random(5)
    texts = []
    for _ in range(60):
        words = [f"w{draw.randrange(40 if draw.random() < 0.3 else 4000)}" for _ in range(draw.choice([99, 100, 101, 150, 3]))]
        words = [w.upper() * 3 if draw.random() < draw.choice([0, 0.1, 0.4]) else w for w in words]
        texts.append(draw.choice([" ", "\n", "  ", " \x0b"]).join(words) + draw.choice(["", "", " #", "|", "é😀"]))
    rows = [(k, draw.choice(texts), draw.choice(["en", "de", None, ""])) for k in range(150)]
    rows += [(None, texts[0], "en"), (None, None, "en"), (200, None, "de"), (201, "", "fr"), rows[3], rows[3], (-5, rows[3][1], "de"), (rows[4][0], texts[1], "en")]
    labels = [(k, draw.choice([0, 1, None]), draw.choice([0, 0, 1])) for k in range(0, 120)] + [(3, 1, 1), (None, 1, 1), (900, 1, 1)]
    return rows, labels


def test_against_rows_one_by_one(spark):
    rows, labels = fixture()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, part int, good int").repartition(3)
    known = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(docs, known).collect()}
    want = brute(rows, labels)
    assert len(want) == 4 * 600 and got == want


def test_positional_popcounts():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 5, 100, 4097):
        words, counts = draw.integers(0, 1 << 32, n, np.uint32), draw.integers(0, 1 << 40, n)
        want = [int(sum(int(c) for w, c in zip(words, counts) if w >> p & 1)) for p in range(32)]
        assert filter_audit.positional_popcounts(words, counts).tolist() == want


def test_survival_words():
    for fails_, word in enumerate(filter_audit.WORDS):
        for subset in range(32):
            assert bool(word >> subset & 1) == (not any(fails_ >> f & 1 and subset >> f & 1 for f in range(5)))


def test_copies_are_few_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, "same text", "en") for k in range(3000)], "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = {(r["fails"], r["n"]) for r in filter_audit.counted(filter_audit.judged(docs), labels).collect()}
    assert counts == {(1, 1), (17, 2999)}
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
