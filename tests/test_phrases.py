import random
import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import lexicon, match, phrases
from newsloom.queries.base import rows_of


def brute(folded, items):
    """Every phrase's own pattern over the whole text."""
    return sorted((m.start(), m.end(), p) for p in items for m in re.finditer(text.pattern_of([p]), folded, re.ASCII))


def test_occurrences_are_those_of_the_patterns():
    draw = random.Random(11)
    words = ["coal", "coals", "gas", "boss", "s", "u.s.", "s&p", "4.5%", "usd/inr", "e-auction", "price", "prices", "of", "the", "a", ".net", "&", "é", "ss"]
    sep = [" ", " ", " ", "-", "/", " - ", ". ", "%", ""]
    seen = 0
    for _ in range(4000):
        items = sorted({" ".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(draw.randint(1, 12))})
        folded = "".join(draw.choice(words) + draw.choice(sep) for _ in range(draw.randint(0, 25))).strip()
        automaton = phrases.Automaton(items)
        got = sorted((a, b, automaton.phrases[k]) for a, b, k in automaton.occurrences(folded))
        want = brute(folded, [p for p in items if re.search("[a-z0-9]", p)])
        assert got == want, (folded, items)
        seen += len(want)
    assert seen > 4000 and phrases.Automaton([]).occurrences("a") == phrases.Automaton(["a"]).occurrences(None) == []


def test_a_text_is_one_pass_whatever_the_lexicon():
    items = [f"w{k} w{k + 1} w{k + 2}" for k in range(50_000)]
    automaton = phrases.Automaton(items)
    folded = " ".join(f"w{k}" for k in range(2000))
    assert len(automaton.occurrences(folded)) == 1998 and len(automaton.patterns) == 1998  # only what is found is compiled


def company(spark, rows):
    return spark.createDataFrame(rows, "ticker string, term string, excludes array<string>")


def folded(spark, *texts):
    rows = spark.createDataFrame([(f"a{k}", t) for k, t in enumerate(texts)], "article_id string, text_f string")
    return rows.withColumn("head_f", F.substring("text_f", 1, 12))


def test_only_blockers_around_an_occurrence_block_it(spark):
    terms = company(spark, [
        ("nested", "ravel", ["ravel electronics", "new ravel electronics shop"]), ("overlap", "coal india", ["india ltd"]), ("touch", "coal", ["india"]), ("twice", "steel", ["steel mill"]),
        ("same", "ore", ["Ore"]), ("none", "gold", []), ("plural", "mine", ["Deep Mines"]),
    ])
    rows = folded(spark, "ravel electronics", "new ravel electronics shop", "ravel near ravel electronics", "coal india ltd", "coal india", "steel mill steel", "steel mills", "ore", "gold-ore", "deep mines", "mines deep")
    got = sorted((r["article_id"], r["ticker"]) for r in match.free(rows, terms, "term").collect())
    assert got == [("a10", "plural"), ("a2", "nested"), ("a3", "overlap"), ("a3", "touch"), ("a4", "overlap"), ("a4", "touch"), ("a5", "twice"), ("a8", "none")]


def test_a_large_lexicon_is_cut_into_passes(spark, monkeypatch):
    terms = company(spark, [(f"t{k}", f"word{k} more", [f"no word{k} more"]) for k in range(60)])
    rows = folded(spark, *[f"word{k} more and word{k + 1} more, no word{k + 2} more" for k in range(50)], "", None)
    whole = sorted(map(tuple, match.free(rows, terms, "term").drop("excludes").collect()))
    assert len(whole) == 100
    monkeypatch.setattr(lexicon, "MOST_CHARS", 400)
    assert lexicon.marked(rows, ("text_f",), (terms, ("term",))) is None
    assert sorted(map(tuple, match.free(rows, terms, "term").drop("excludes").collect())) == whole
    assert lexicon.hits(rows.limit(0), terms, "article_id", "text_f", "term").count() == lexicon.hits(rows, terms.limit(0), "article_id", "text_f", "term").count() == 0


def test_no_pattern_is_a_column(spark):
    terms = company(spark, [("t", "word more", ["no word more"])])
    found = match.free(folded(spark, "word more"), terms, "term")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(?<![a-z0-9])" not in plan and "n_words" not in plan


def test_a_batch_full_of_phrases_takes_little_memory():
    """300,000 occurrences in 300 texts: some 16 bytes each beside the result, not Python objects; what is found is the same."""
    automaton = phrases.Automaton(["the", "of the", "steel"])
    texts = pa.array(["of the " * 500, None, "", *["the plain word " * 1000] * 300])
    phrases.marks_of(automaton, texts[:4])
    tracemalloc.start()
    found = phrases.marks_of(automaton, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * len(found.flatten()) and len(found.flatten()) == 1000 + 300_000
    assert found.to_pylist()[3] == [{"phrase": "the", "start": 15 * k, "end": 15 * k + 3} for k in range(1000)] and found.to_pylist()[1:3] == [[], []]


def test_fixed_rows_start_no_python(spark):
    rows = rows_of(spark, [("T1", None, ["a", "b"], 1.5), ("T2", "x", [], None)], "ticker string, role string, excludes array<string>, w double")
    assert [tuple(r) for r in rows.collect()] == [("T1", None, ["a", "b"], 1.5), ("T2", "x", [], None)]
    assert "LocalRelation" in rows._jdf.queryExecution().optimizedPlan().toString()
    none = rows_of(spark, [], "ticker string, pos int")
    assert none.count() == 0 and none.dtypes == [("ticker", "string"), ("pos", "int")]
