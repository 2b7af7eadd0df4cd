"""What is asked of an event's texts: once for a text, with the results of the rules themselves."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F
from test_isolation import landed

from newsloom.functions import text
from newsloom.operators import wording
from newsloom.plans import daily
from newsloom.queries.article_queries import linked_of


def test_rows_of_companies_ask_nothing_of_texts(spark):
    good, _ = daily.isolated(landed(spark, 40))
    good = good.withColumns({"head_f": text.fold(F.col("title")), "text_f": text.fold(F.concat_ws(" ", "title", "summary"))})
    scored = daily.assess(*linked_of(spark, good)).select("event_id", "ticker", "impact_score", "direction", "confidence", "why")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert not any(w in plan for w in ("rises", "slumps", "crore", "multi-year", "shutdown", "penalty")) and scored.count() > 10


def test_movement_is_that_of_the_words_and_the_anchor(spark):
    draw = random.Random(5)
    vocabulary = ["rises", "gain", "falls", "record low", "record high", "copper wire", "copper wires", "market", "x", "the", "uphill"]
    cases = [(k, *(" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(n))) for n in (5, 12)), draw.choice([None, "copper wire", "zinc"])) for k in range(400)]
    rows = spark.createDataFrame([*cases, (400, None, None, "copper wire"), (401, None, "x rises", None)], "k int, head_f string, text_f string, anchor string")

    def moved(folded, anchor):
        at = [[m.start() for m in re.finditer(text.pattern_of(words), folded)] for words in (wording.UP, wording.DOWN)]
        place = re.search(text.pattern_of([anchor]), folded) if anchor else None
        near = [min((abs(p - (place.start() if place else 0)) for p in x), default=None) for x in at]
        if None in near:
            return "up" if near[0] is not None else "down" if near[1] is not None else None
        return "up" if near[0] < near[1] else "down" if near[1] < near[0] else None

    made = wording.anchored(wording.worded(rows), F.col("anchor"))
    got = {r["k"]: r["m"] for r in made.select("k", F.coalesce(wording.movement("head"), wording.movement("body")).alias("m")).collect()}
    want = {k: moved(head, anchor) or moved(f"{head} {body}", anchor) for k, head, body, anchor in cases}
    assert got == want | {400: None, 401: "up"} and {*want.values()} == {"up", "down", None}
