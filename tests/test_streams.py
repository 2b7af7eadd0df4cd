import datetime as dt

from pyspark.sql import functions as F

from newsloom.operators import cluster, normalize, store
from newsloom.plans import daily
from newsloom.streaming import streams

EVENT = "event_id string, title string, cluster_key string, event_date date, event_types array<string>, tickers array<string>, is_international boolean, has_official boolean, primary_source string, max_impact int, scope string, year int"
STOCK = "event_id string, ticker string, relationship string, impact_score int, direction string, confidence double"
D = dt.date(2026, 9, 22)


def row(i, title, day=D, score=5):
    return (f"EVENT-T-2026-{i:04d}", title, "", day, ["ORDER_WIN"], ["T"], False, False, "p", score, "T", 2026)


def test_late_evidence_is_absorbed(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.createDataFrame([row(1, "Acme wins solar order")], EVENT).write.parquet(f"{path}/event/batch=0")
    spark.createDataFrame([("EVENT-T-2026-0001", "T", "DIRECT", 5, "POSITIVE", 0.5)], STOCK).write.parquet(f"{path}/event_stock/batch=0")
    incoming = spark.createDataFrame([row(11, "Acme bags solar order", D + dt.timedelta(days=9), 8), row(12, "Other thing")], EVENT)
    incoming = incoming.withColumn("stocks", F.array(F.struct(F.lit("T").alias("ticker"), F.lit("DIRECT").alias("relationship"), F.col("max_impact").alias("impact_score"), F.lit("POSITIVE").alias("direction"), F.lit(0.7).alias("confidence"))))
    incoming.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(incoming.schema).parquet(str(tmp_path / "in"))
    streams.absorb(stream, path, str(tmp_path / "state")).awaitTermination()
    events = {r["event_id"][-4:]: r["max_impact"] for r in streams.current(spark, path, "event").collect()}
    stocks = {r["event_id"][-4:]: r["impact_score"] for r in streams.current(spark, path, "event_stock").collect()}
    assert events == {"0001": 8, "0012": 5} and stocks == {"0001": 8, "0012": 5}
    # an event that nothing touches is not written again
    later = spark.createDataFrame([row(13, "Acme wins solar order", D, 9)], EVENT).withColumn("stocks", F.array(F.struct(F.lit("U").alias("ticker"), F.lit("DIRECT").alias("relationship"), F.lit(9).alias("impact_score"), F.lit("POSITIVE").alias("direction"), F.lit(0.7).alias("confidence"))))
    later.write.mode("append").parquet(str(tmp_path / "in"))
    streams.absorb(stream, path, str(tmp_path / "state")).awaitTermination()
    assert {r["event_id"][-4:] for r in spark.read.parquet(f"{path}/event/batch=2").collect()} == {"0001"}
    assert {(r["event_id"][-4:], r["ticker"]) for r in streams.current(spark, path, "event_stock").collect()} == {("0001", "T"), ("0001", "U"), ("0012", "T")}
    assert {r["event_id"][-4:]: r["max_impact"] for r in streams.current(spark, path, "event").collect()} == {"0001": 9, "0012": 5}


def test_stream_keeps_the_first_of_each_key(spark, tmp_path):
    rows = [(k % 3, dt.datetime(2026, 9, 22) + dt.timedelta(hours=k), 1.0) for k in range(9)]
    spark.createDataFrame(rows, "article_id long, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("article_id long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    assert streams.drained(streams.fresh(stream, "article_id"), "append", str(tmp_path), "a").count() == 3
    assert {r["n"] for r in streams.drained(streams.sessions(stream, ["article_id"], "4 hours"), "complete", str(tmp_path), "b").collect()} == {3}


def test_snapshots_replace_their_day(spark, tmp_path):
    path = str(tmp_path / "days")
    for day, n in (("d1", 3), ("d2", 2), ("d1", 1)):
        store.save_day(spark.range(n).withColumn("run_date", F.lit(day)), path)
    assert {r["run_date"]: r["count"] for r in spark.read.parquet(path).groupBy("run_date").count().collect()} == {"d1": 1, "d2": 2}


def test_daily_plan(spark):
    when = dt.datetime(2026, 9, 22, 6)
    rows = [(f"a{k}", t, "", f"https://d{k}.com/{k}", "", f"d{k}.com", "unknown", when, False) for k, t in enumerate(["Acme wins order - Daily Wire", "Acme wins order", "Old"])]
    rows[2] = (*rows[2][:7], when - dt.timedelta(days=9), False)
    landed = spark.createDataFrame(rows, "article_id string, title string, summary string, url string, source_name string, source_domain string, source_type string, published timestamp, is_official boolean")
    domains = spark.createDataFrame([("d0.com", "wire")], "domain string, type string")
    now = F.lit("2026-09-22 12:00:00").cast("timestamp")
    fresh = daily.fresh_articles(landed, spark.createDataFrame([], "article_id string"), domains, now)
    assert sorted((r["title"], r["source_type"]) for r in fresh.collect()) == [("Acme wins order", "unknown"), ("Acme wins order", "wire")]
    assert daily.fresh_articles(landed, fresh.select("article_id"), domains, now).count() == 0


def test_sequences_go_on(spark):
    events = spark.createDataFrame([("c1", "T", D), ("c2", "T", D), ("c3", "GLOBAL", D)], "cluster_id string, scope string, event_date date")
    before = spark.createDataFrame([("T", 2026, 41)], "scope string, year int, sequence int")
    assert sorted(r["event_id"] for r in cluster.with_ids(events, before).collect()) == ["EVENT-GLOBAL-2026-0001", "EVENT-T-2026-0042", "EVENT-T-2026-0043"]
    assert normalize.QUALITY["wire"] == 9


def test_earlier_headlines_and_lenders(spark):
    events = spark.createDataFrame([("c1", "EVENT-T-2026-0009", "Money market notes of the day", "", D, ["MACRO"], ["T"]), ("c2", "EVENT-U-2026-0001", "Quite another thing", "", D, ["MACRO"], ["U"])], "cluster_id string, event_id string, title string, cluster_key string, event_date date, event_types array<string>, tickers array<string>")
    stored = spark.createDataFrame([row(1, "Money market notes of the day", D - dt.timedelta(days=3))], EVENT)
    sources = spark.createDataFrame([("EVENT-T-2026-0001", "Auction result"), ("EVENT-T-2026-0001", "Notes"), ("EVENT-T-2026-0001", ""), ("EVENT-Z-2026-0001", "Auction result")], "event_id string, title string")
    got = daily.earlier_flags(events, stored, sources, {"routine_release": ["auction result"]})
    assert sorted((r["cluster_id"], r["routine_release"], r["opinion"]) for r in got.collect()) == [("c1", False, False), ("c1", True, False)]
    lead = [("c1", f"a{k}", f"{k}" * 5, k, False, "wire", False) for k in range(3)]
    members = spark.createDataFrame(lead, "cluster_id string, article_id string, title string, position int, is_official boolean, source_type string, routine_release boolean")
    flags = lambda before: cluster.suppressive_flags(members, ["routine_release"], before).first()["routine_release"]
    again = spark.createDataFrame([("c1", True), ("c1", True)], "cluster_id string, routine_release boolean")
    assert not flags(None) and flags(again) and not flags(again.limit(1))
