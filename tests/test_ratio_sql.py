"""The sequence ratio as SQL, which the queries' SQL is built from, against the library's own ratio."""

import difflib
import random

import duckdb

from newsloom.operators.dedup import sequence_ratio
from newsloom.queries.base import decimal_round_sql, ratio_sql


def test_ratio_of_random_texts(spark):
    draw = random.Random(1)
    words = "the of market river stone thea onin reth hein anti naïve".split()
    line = lambda: " ".join(draw.choices(words, k=draw.randint(0, 14)))
    rows = [(k, line(), "".join(draw.choices("abc ", k=draw.randint(0, 60))) if k % 3 == 0 else line()) for k in range(1500)]
    rows += [(2000, "", ""), (2001, "a", ""), (2002, "abab", "baba"), (2003, "aaaa", "aa"), (2004, "same text", "same text")]
    con = duckdb.connect()
    con.execute("create table p (id bigint, a varchar, b varchar)")
    con.executemany("insert into p values (?, ?, ?)", rows)
    found = dict(con.sql(f"WITH RECURSIVE {ratio_sql('SELECT id, a, b FROM p')} SELECT id, ratio FROM ratios").fetchall())
    want = {k: difflib.SequenceMatcher(None, a, b).ratio() for k, a, b in rows}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    df = spark.createDataFrame(rows, "id long, a string, b string")
    assert {r["id"]: r["r"] for r in df.select("id", sequence_ratio("a", "b").alias("r")).collect()} == want


def test_rounding_by_the_decimal_form():
    for x, want in ((0.056249999999999994, 0.0562), (0.05625, 0.0563), (0.00005, 0.0001), (0.88, 0.88), (1.0, 1.0)):
        assert duckdb.sql(f"SELECT {decimal_round_sql(repr(x) + '::DOUBLE')}").fetchall()[0][0] == want
