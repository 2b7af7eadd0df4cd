import itertools
import random

from newsloom.llm import jaccard_join as join

WORDS = [f"w{k}" for k in range(400)]


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (class, links) over the distinct texts."""
    kinds = {}
    for i, t in rows:
        kinds.setdefault(tuple((t or "").lower().split()), []).append(i)
    keys = list(kinds)
    sets, parent, links = [grams(" ".join(k)) for k in keys], list(range(len(keys))), [0] * len(keys)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(keys)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a], links[b] = links[a] + 1, links[b] + 1
            parent[find(a)] = find(b)
    groups = {}
    for k in range(len(keys)):
        groups.setdefault(find(k), []).extend(kinds[keys[k]])
    return {i: (min(groups[find(k)]), links[k], len(kinds[keys[k]])) for k, key in enumerate(keys) for i in kinds[key]}


def changed(draw, text, n):
    words = text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = draw.choice(WORDS)
    return " ".join(words)


def fixture():
    draw = random.Random(5)
    text = lambda n: " ".join(draw.choices(WORDS, k=n))
    texts = [text(draw.choice([1, 3, 5, 6, 40, 200])) for _ in range(60)]
    texts += [changed(draw, t, draw.randint(1, 6)) for t in texts if len(t.split()) > 30 for _ in range(3)]
    base = text(120)
    texts += [changed(draw, base, draw.randint(0, 3)) for _ in range(330)]  # one large group, over several chunks
    texts += [base] * 40 + [base.upper(), base.replace(" ", "\n"), None, "", "  ", "a", "A", text(30_000)]
    return [(100 + k, t) for k, t in enumerate(texts)]


def test_every_link_of_a_small_corpus(spark, monkeypatch):
    monkeypatch.setattr(join, "CHUNK_TEXTS", 64)
    rows = fixture()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key int, class_id int")
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in join.links(docs).collect()}
    assert got == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in [*rows, rows[0], rows[0]]], "doc_id long, text string, lang string, source string, n_chars long")
    kept = join.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _, _ in brute(rows).values()})


def test_nulls_and_emptiness(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_copies"]) for r in join.links(docs).collect()), key=str)
    assert got == sorted([(None, 3, 3), (3, 3, 3), (3, 3, 3), (None, None, 1)], key=str)
    assert join.links(docs.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = join.banding()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= join.MOST_HASHES


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    assert {(r["node"], r["root"]) for r in join.components(edges).collect()} == {(k, 0) for k in range(1, 61)} | {(101, 100)}


def test_pairs_at_the_threshold_are_linked(spark):
    """Texts a and b have 4k shingles in common and sizes that sum to 9k; c has one more, so a and c are below. Then
    two texts of 40 words that differ in the fourth, with 32 of 40 shingles in common."""
    rows = []
    for k in (1, 2, 3, 8, 9, 16, 50, 125, 399):
        left, right = 9 * k // 2, 9 * k - 9 * k // 2
        shared = [f"s{k}x{j}" for j in range(4 * k + 4)]
        texts = [shared + [f"{side}{k}x{j}" for j in range(n - 4 * k)] for side, n in (("a", left), ("b", right), ("c", right + 1))]
        rows += [(len(rows) + j, " ".join(t)) for j, t in enumerate(texts)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in join.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert all(got[i][1] >= 1 for i, _ in rows if i % 3 == 1)
    words = [f"w{j}" for j in range(40)]
    tied = [(0, " ".join(words)), (1, " ".join([*words[:3], "other", *words[4:]]))]
    assert {r["n_links"] for r in join.links(spark.createDataFrame(tied, "doc_id long, text string")).collect()} == {1}


def test_a_row_without_an_id_does_not_hide_its_copies(spark):
    words = [f"w{j}" for j in range(60)]
    rows = [(None, " ".join(words).upper()), (5, "  ".join(words)), (6, " ".join([*words, "more"]))]
    got = {(r["doc_id"], r["copy_id"], r["class_id"], r["n_links"]) for r in join.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 5, 5, 1), (5, 5, 5, 1), (6, 6, 5, 1)}


def test_clashing_columns(spark):
    names = ["kept_id", "kept_hash", "rows", "text_hash", "key", "chunk", "tile", "copy_id", "class_id"]
    rows = [(1, "a b c d e f g", *names), (1, "a b c d e f g", *names), (2, "a b c d e f g", *names), (3, "x", *names), (None, None, *names)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = join.first_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)
