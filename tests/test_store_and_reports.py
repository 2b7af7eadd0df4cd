import datetime as dt
import difflib
import random

from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import planning, report, signals, store

EVENT = "event_id string, title string, cluster_key string, event_date date, event_types array<string>, tickers array<string>, is_international boolean, has_official boolean, primary_source string, max_impact int, scope string, year int"
D = dt.date(2026, 9, 22)


def event(i, title, key="", day=D, kinds=("ORDER_WIN",), tickers=("T",), official=False, score=5):
    return (f"EVENT-T-2026-{i:04d}", title, key, day, list(kinds), list(tickers), False, official, f"p{i}", score, "T", 2026)


def test_find_existing(spark):
    stored = spark.createDataFrame([event(1, "Acme wins solar order"), event(2, "Other words", "k"), event(3, "Acme wins solar order", day=D - dt.timedelta(days=30)), event(4, "Acme wins solar order", tickers=["Z"])], EVENT)
    incoming = spark.createDataFrame([event(11, "Acme bags solar order", day=D + dt.timedelta(days=20)), event(12, "Nothing like it", "k"), event(13, "Quite new story")], EVENT)
    got = {(r["incoming_id"][-2:], r["event_id"][-1:]) for r in store.find_existing(incoming, stored).collect()}
    assert got == {("11", "1"), ("12", "2")}


def test_find_existing_meets_every_similar_title(spark):
    draw = random.Random(7)
    words = ["solar", "order", "plant", "steel", "coal", "export", "duty", "merger"]
    title = lambda: " ".join(draw.choice(words) for _ in range(draw.randint(1, 6)))
    made = [event(k, title(), draw.choice(["", "k1", "k2"]), D + dt.timedelta(days=draw.randint(0, 70)), [draw.choice(["TENDER", "FRAUD"])], draw.sample(["T", "U", "V"], draw.randint(1, 2))) for k in range(90)]
    stored, incoming = made[:70], made[70:]
    canonical = {r["t"]: set(r["w"]) for r in spark.createDataFrame([(m[1],) for m in made], "t string").select("t", text.canonical_tokens(text.fold(F.col("t"))).alias("w")).collect()}
    want = {}
    for i in incoming:
        best = None
        for s in stored:
            if not set(i[5]) & set(s[5]) or abs((i[3] - s[3]).days) > 21:
                continue
            same = i[2] == s[2] != ""
            a, b = canonical[i[1]], canonical[s[1]]
            contained = len(a & b) / min(len(a), len(b))
            likeness = round(max(0.5 * len(a & b) / len(a | b) + 0.3 * difflib.SequenceMatcher(None, i[1], s[1]).ratio() + 0.2 * contained, 0.8 * contained), 4)
            score = round(likeness + (0.1 if i[4] == s[4] else 0), 4)
            if (same or score >= 0.55) and (best is None or (not same, -score, s[0]) < best):
                best = (not same, -score, s[0])
        if best:
            want[i[0]] = best[2]
    got = {r["incoming_id"]: r["event_id"] for r in store.find_existing(spark.createDataFrame(incoming, EVENT), spark.createDataFrame(stored, EVENT)).collect()}
    assert got == want and len(want) > 5


def test_merge(spark):
    stored = spark.createDataFrame([event(1, "Rumour", score=5), event(2, "Same", score=4)], EVENT)
    incoming = spark.createDataFrame([event(11, "Confirmed", day=D - dt.timedelta(days=2), kinds=["TENDER"], tickers=["U"], official=True, score=9), event(12, "New", score=3)], EVENT)
    found = spark.createDataFrame([("EVENT-T-2026-0011", "EVENT-T-2026-0001")], "incoming_id string, event_id string")
    got = {r["event_id"][-4:]: r for r in store.merge_events(incoming, stored, found).collect()}
    assert set(got) == {"0001", "0002", "0012"}
    r = got["0001"]
    assert (r["title"], r["event_types"], r["tickers"], r["event_date"], r["max_impact"], r["has_official"]) == ("Confirmed", ["ORDER_WIN", "TENDER"], ["T", "U"], D - dt.timedelta(days=2), 9, True)
    kind = "event_id string, ticker string, relationship string, impact_score int, direction string, confidence double"
    old = spark.createDataFrame([("A", "T", "DIRECT", 5, "POSITIVE", 0.5), ("A", "V", "DIRECT", 9, "POSITIVE", 0.5)], kind)
    new = spark.createDataFrame([("x1", "T", "DIRECT", 8, "POSITIVE", 0.6), ("x2", "T", "DIRECT", 3, "NEGATIVE", 0.7), ("x1", "U", "SECTOR", 4, "MIXED", 0.2), ("x1", "V", "DIRECT", 7, "POSITIVE", 0.9)], kind)
    both = spark.createDataFrame([("x1", "A"), ("x2", "A")], "incoming_id string, event_id string")
    got = {r["ticker"]: (r["impact_score"], r["direction"], [x["change"] for x in r["log"]]) for r in store.merge_stocks(new, old, both).collect()}
    # a changed direction replaces even a higher score
    assert got == {"T": (3, "NEGATIVE", ["impact raised", "direction changed"]), "U": (4, "MIXED", ["stock added"]), "V": (9, "POSITIVE", [])}


def test_save_and_query(spark, tmp_path):
    events = spark.createDataFrame([event(k, "t", day=D - dt.timedelta(days=k), score=k) for k in range(10)], EVENT)
    store.save(events, str(tmp_path / "events"))
    back = spark.read.parquet(str(tmp_path / "events"))
    assert [r["max_impact"] for r in store.query(back, "t", ["order_win"], "2026-09-14", "2026-09-20", 4).collect()] == [4, 5, 6, 7, 8]
    assert store.by_id(back, "EVENT-T-2026-0003").count() == 1
    store.save(spark.createDataFrame([event(77, "only")], EVENT), str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).count() == 1
    assert {r["ticker"]: r["events"] for r in store.stats(back.limit(0)).collect()} == {"*": 0}


def test_leanings(spark):
    df = spark.createDataFrame([(2, 2), (3, 2), (20, 3), (20, 4), (3, -2), (5, 0)], "m int, n int").select(signals.leaning(F.col("m"), F.col("n")))
    assert [r[0] for r in df.collect()] == ["too few to read", "mostly positive", "mixed", "mostly positive", "mostly negative", "mixed"]
    words = spark.createDataFrame([("I love it",), ("badly broken",), ("good but bad",), (None,)], "t string").select(signals.label(F.lower(F.coalesce("t", F.lit("")))))
    assert [r[0] for r in words.collect()] == ["positive", "negative", "neutral", "neutral"]


def test_failure_reasons(spark):
    df = spark.createDataFrame([("403 Client Error",), ("Read timed out",), ("Max retries: connection refused",), ("not JSON",), ("HTTP 503",), (None,)], "e string").select(report.failure_reason(F.col("e")))
    assert [r[0] for r in df.collect()] == ["403 Blocked", "Timeout", "Unreachable", "Not JSON", "HTTP 503", ""]


def test_searches(spark):
    profiles = spark.createDataFrame([("T", "Acme Solar", "solar", "India")], "ticker string, company string, industry string, country string")
    lists = spark.createDataFrame([("T", "regulators", 0, "SEBI"), ("T", "regulators", 1, "MNRE"), ("T", "commodities", 0, "copper"), ("T", "competitors", 0, "Zed Power"), ("T", "sector_topics", 0, "solar"), ("T", "sector_topics", 1, "Solar")], "ticker string, field string, pos int, term string")
    got = {(r["kind"], r["text"]) for r in planning.candidates(profiles, lists).collect()}
    assert got == {("COMPANY", '"Acme Solar"'), *[("COMPANY", f'"Acme Solar" {m}') for m in planning.MODIFIERS], ("REGULATORY", "MNRE solar"), ("COMMODITY", "copper price"), ("COMPETITOR", '"Zed Power"'), ("SECTOR", "solar")}


def test_answers(spark):
    raw = spark.createDataFrame([("E", "T", 'Here: {"summary": "Strong buy now", "risks": ["cost", "sell the stock"], "x": 1} bye'), ("F", "T", "none")], "event_id string, ticker string, answer string")
    got = {r["event_id"]: r for r in planning.answers(raw).collect()}
    assert got["E"]["outcome"] == "enriched" and got["E"]["answer"]["summary"] == "[removed] now" and got["E"]["answer"]["risks"] == ["cost"] and got["F"]["outcome"] == "error"
    pairs = spark.createDataFrame([("E", "T", "Title", "DIRECT", 9, "POSITIVE", [("COMMODITY", "coal")])], "event_id string, ticker string, title string, relationship string, impact_score int, direction string, exposures array<struct<exposure_type:string,term:string>>")
    assert "commodity - coal" in planning.prompts(pairs).first()["prompt"]
