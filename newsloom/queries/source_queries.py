"""Readers and sinks over payloads that the given tables make: a projection is written to the shared folder in a source's
form, read by its reader, and must come back. A payload holds 100 documents, so that files grow with the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators import graph, report, store
from newsloom.queries.base import PAIRS, TICKERS, pairs, rows_of, table, values_sql
from newsloom.queries.event_queries import _STORED, stored_events
from newsloom.sources import landing, seam
from newsloom.streaming import streams

QUERIES, ORACLES = {}, {}
COMPANIES = [(t, f"Company {t} Ltd") for t in TICKERS]
A_PAYLOAD = 100


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__], ORACLES[function.__name__] = function, sql
        return function

    return add


def items(spark, sf_dir) -> DataFrame:
    """Documents as items of a feed."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i, F.floor(i / A_PAYLOAD).alias("payload"), F.concat(F.lit("Item "), i.cast("string"), F.lit(" in "), "lang").alias("title"), F.concat(F.lit("https://"), "source", F.lit(".example.com/"), i.cast("string")).alias("url"),
        F.concat("source", F.lit(".example.com")).alias("domain"), F.format_string("T%02d", i % 13).alias("symbol"), F.timestamp_add("MINUTE", (37 * i).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("seen"), F.col("n_chars").cast("long").alias("n_chars"),
    )


_ITEMS = """i AS (SELECT doc_id, doc_id // 100 AS payload, 'Item ' || doc_id || ' in ' || lang AS title, 'https://' || source || '.example.com/' || doc_id AS url, source || '.example.com' AS domain,
    'T' || lpad((doc_id % 13)::VARCHAR, 2, '0') AS symbol, TIMESTAMP '2024-01-01' + to_minutes(37 * doc_id) AS seen, n_chars::BIGINT AS n_chars FROM documents)"""
_AT = "strftime(seen, '%Y-%m-%d %H:%M:%S') AS published"


def folder(spark) -> str:
    return f"{graph.shared_folder(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"


def landed(rows: DataFrame, shape) -> str:
    """Each payload as a JSON file of its own; returns their folder."""
    path = folder(rows.sparkSession)
    rows.groupBy("payload").agg(F.collect_list(shape).alias("list")).select(F.to_json(F.struct("list")).alias("value")).withColumn("value", F.regexp_extract("value", r"(?s)^\{\"list\":(.*)\}$", 1)).write.option("maxRecordsPerFile", 1).text(path)
    return path


def wrapped(rows: DataFrame, shape, *names: str) -> str:
    """The same with each list under some nested names."""
    path = folder(rows.sparkSession)
    body = F.collect_list(shape)
    made = rows.groupBy("payload").agg(body.alias("list")).select("list")
    for name in reversed(names):
        made = made.select(F.struct(F.col(made.columns[0]).alias(name)).alias("value"))
    made.select(F.to_json("value").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def shown(df: DataFrame, *columns: str) -> DataFrame:
    when = F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published")
    return df.select(*[when if c == "published" else F.array_join(c, ",").alias(c) if c == "tickers_hint" else F.col(c) for c in columns])


def _feed_files(spark, sf_dir):
    """Items as feed files; every tenth has no link."""
    rows, path = items(spark, sf_dir), folder(spark)
    link = F.when(F.col("doc_id") % 10 != 0, F.col("url"))
    made = rows.select("title", link.alias("link"), F.date_format("seen", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pubDate"), F.struct(F.col("domain").alias("_VALUE"), F.col("url").alias("_url")).alias("source"))
    made.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    return path


_FEED = f"WITH {_ITEMS} SELECT title, url, domain AS source_name, {_AT} FROM i WHERE doc_id % 10 <> 0"


@query(_FEED)
def source_feed(spark, sf_dir):
    """Feed items (SC1); every tenth has no link and goes."""
    return shown(landing.rss(spark, _feed_files(spark, sf_dir)), "title", "url", "source_name", "published")


@query(_FEED)
def stream_source_feed(spark, sf_dir):
    """The same files read as a stream, a few a batch."""
    found = seam.landed(spark, "feed", _feed_files(spark, sf_dir), stream=True, files_per_batch=4)
    return shown(streams.drained(found, "append", graph.shared_folder(spark), f"feed_{uuid.uuid4().hex}"), "title", "url", "source_name", "published")


@query(f"""WITH {_ITEMS}, r AS (SELECT title, url, 'query ' || payload AS query, 'T' || lpad((payload % 11)::VARCHAR, 2, '0') AS query_ticker, seen FROM i)
    SELECT title, url, query, query_ticker FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY seen DESC, url) <= 20""")
def source_search(spark, sf_dir):
    """The 20 latest items of each search, with what it asked for (SC2)."""
    rows = items(spark, sf_dir).withColumn("query", F.concat(F.lit("query "), F.col("payload").cast("string")))
    searches = rows.select("query", "payload").distinct().select("query", F.lit("company").alias("kind"), F.format_string("T%02d", F.col("payload") % 11).alias("ticker"), F.lit("term").alias("term"))
    found = landing.search_feed(rows.select("title", "url", "query", F.col("seen").alias("published")), searches, 20)
    return found.select("title", "url", "query", "query_ticker")


@query(f"WITH {_ITEMS} SELECT title, url, domain AS source_domain, {_AT} FROM i WHERE doc_id % 9 <> 0")
def source_index(spark, sf_dir):
    """An index's answers (SC3); every ninth has no address."""
    shape = F.struct(F.when(F.col("doc_id") % 9 != 0, F.col("url")).alias("url"), "title", "domain", F.date_format("seen", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"))
    return shown(landing.document_index(spark, wrapped(items(spark, sf_dir), shape, "articles")), "title", "url", "source_domain", "published")


@query(f"WITH {_ITEMS} SELECT 'Company ' || symbol || ' Ltd: ' || title AS title, url, symbol AS tickers_hint, {_AT}, true AS is_official FROM i WHERE symbol < 'T11'")
def source_exchange(spark, sf_dir):
    """An exchange's announcements, payloads under ``data`` and plain lists, of known companies only (SC4)."""
    rows = items(spark, sf_dir)
    shape = F.struct("symbol", F.col("title").alias("desc"), F.col("url").alias("attchmntFile"), F.date_format("seen", "dd-MMM-yyyy HH:mm:ss").alias("an_dt"))
    known = rows_of(spark, COMPANIES, "ticker string, company string")
    found = [landing.exchange_announcements(spark, path, known) for path in (wrapped(rows.filter("payload % 2 = 0"), shape, "data"), landed(rows.filter("payload % 2 = 1"), shape))]
    return shown(found[0].unionByName(found[1]), "title", "url", "tickers_hint", "published", "is_official")


@query(f"WITH {_ITEMS} SELECT 'Company T' || lpad((payload % 11)::VARCHAR, 2, '0') || ' Ltd: ' || title AS title, 'https://files.example.com/' || doc_id AS url, 'T' || lpad((payload % 11)::VARCHAR, 2, '0') AS tickers_hint, {_AT} FROM i WHERE payload % 3 <> 1")
def source_second_exchange(spark, sf_dir):
    """The other exchange's payloads, one company each; every third names another company and goes whole (SC5)."""
    ticker = F.format_string("T%02d", F.col("payload") % 11)
    named = F.when(F.col("payload") % 3 == 1, "Another Firm").otherwise(F.concat(F.lit("Company "), ticker, F.lit(" Ltd")))
    shape = F.struct(F.col("title").alias("HEADLINE"), named.alias("SLONGNAME"), ticker.alias("SCRIP_CD"), F.col("doc_id").cast("string").alias("ATTACHMENTNAME"), F.date_format("seen", "yyyy-MM-dd'T'HH:mm:ss").alias("DT_TM"))
    codes = rows_of(spark, [(t, t, c) for t, c in COMPANIES], "code string, ticker string, company string")
    return shown(landing.second_exchange(spark, wrapped(items(spark, sf_dir), shape, "Table"), codes, "https://files.example.com/"), "title", "url", "tickers_hint", "published")


_WATCHED = [("Board A", "T01"), ("board a", "T02"), ("board b", "T02"), ("board d", "T03")]


@query(f"""WITH {_ITEMS}, w(alias, ticker) AS ({values_sql([(a.lower(), t) for a, t in _WATCHED[1:]])}), k AS (SELECT alias, string_agg(ticker, ',' ORDER BY ticker) AS tickers FROM w GROUP BY alias)
    SELECT title, 'Board ' || (['A', 'B', 'C'])[doc_id % 3 + 1] AS regulator, coalesce(tickers, '') AS tickers_hint, true AS is_official FROM i LEFT JOIN k ON lower('Board ' || (['A', 'B', 'C'])[doc_id % 3 + 1]) = alias""")
def source_regulators(spark, sf_dir):
    """Items of regulators with the companies that watch them (SC6)."""
    rows = items(spark, sf_dir).select("title", F.concat(F.lit("Board "), F.get(F.array(*[F.lit(x) for x in "ABC"]), (F.col("doc_id") % 3).cast("int"))).alias("regulator"))
    return shown(landing.regulator_items(rows, rows_of(spark, _WATCHED[1:], "alias string, ticker string")), "title", "regulator", "tickers_hint", "is_official")


@query("SELECT ps_name AS name FROM (SELECT s_name AS ps_name, s_suppkey AS k FROM supplier) WHERE k % 4 = 0 OR k % 11 IN (2, 5)")
def source_wanted(spark, sf_dir):
    """Feeds that serve one of two companies, or all (SC9): suppliers stand for feeds."""
    k = F.col("s_suppkey")
    feeds = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.format_string("T%02d", k % 11))).alias("tickers"))
    return landing.wanted_feeds(feeds, ["T02", "T05"]).select("name")


@query(f"WITH {_ITEMS} SELECT title, 'https://forum.example.com/p/' || doc_id AS url, 'r/' || symbol AS source_name, CASE WHEN doc_id % 6 <> 0 THEN strftime(seen, '%Y-%m-%d %H:%M:%S') END AS published, n_chars AS score FROM i WHERE doc_id % 7 <> 0 AND n_chars >= 200")
def source_forum(spark, sf_dir):
    """A forum's listings: adult and low posts go, no time is no date (SC10)."""
    i = F.col("doc_id")
    post = F.struct("title", F.concat(F.lit("/p/"), i.cast("string")).alias("permalink"), F.col("symbol").alias("subreddit"), F.col("n_chars").alias("score"), (i % 7 == 0).alias("over_18"), F.when(i % 6 != 0, F.unix_seconds("seen").cast("double")).otherwise(0.0).alias("created_utc"))
    found = landing.forum(spark, wrapped(items(spark, sf_dir), F.struct(post.alias("data")), "data", "children"), "https://forum.example.com", 200)
    return shown(found, "title", "url", "source_name", "published", "score")


@query(f"WITH {_ITEMS} SELECT title || ' & more' AS title, 'https://video.example.com/v' || doc_id AS url, symbol AS source_name, {_AT}, true AS consumer FROM i WHERE doc_id % 5 <> 0")
def source_videos(spark, sf_dir):
    """Video searches; what isn't a video has no id (SC11)."""
    i = F.col("doc_id")
    name = F.when(i % 5 != 0, F.concat(F.lit("v"), i.cast("string")))
    shape = F.struct(F.struct(name.alias("videoId")).alias("id"), F.struct(F.concat("title", F.lit(" &amp; more")).alias("title"), F.col("symbol").alias("channelTitle"), F.date_format("seen", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt")).alias("snippet"))
    return shown(landing.videos(spark, wrapped(items(spark, sf_dir), shape, "items"), "https://video.example.com/"), "title", "url", "source_name", "published", "consumer")


@query(f"WITH {_STORED} SELECT min(event_id) AS event_id, min(event_date)::VARCHAR AS event_date, ticker AS tickers, max(max_impact) AS max_impact FROM s GROUP BY ticker, year(event_date)")
def source_event_files(spark, sf_dir):
    """One event a file, by year and scope, read back with the companies as a map, as the store's index (SC12, ES9). All
    events of a scope and year are put together, as a file each is the form."""
    path = folder(spark)
    events = stored_events(spark, sf_dir).groupBy("year", "scope").agg(F.min("event_id").alias("event_id"), F.min("event_date").alias("event_date"), F.max("max_impact").alias("max_impact"), F.min("title").alias("title"), F.min("event_types").alias("event_types"), F.min("cluster_key").alias("cluster_key"))
    stock = F.struct(F.lit("DIRECT").alias("relationship"), F.col("max_impact").alias("impact_score"))
    body = F.to_json(F.struct("event_id", "title", "event_date", "event_types", "cluster_key", F.create_map("scope", stock).alias("stocks")))
    events.select("year", "scope", body.alias("value")).write.partitionBy("year", "scope").option("maxRecordsPerFile", 1).text(path)
    made = store.rebuild_index(landing.event_files(spark, path))
    return made.select("event_id", F.col("event_date").cast("string").alias("event_date"), F.array_join("tickers", ",").alias("tickers"), "max_impact")


@query(f"WITH {_ITEMS} SELECT title, url, {_AT}, '' AS summary, 'unknown' AS source_type, false AS is_official FROM i")
def source_given(spark, sf_dir):
    """Any frame with some of the columns (SC13)."""
    rows = items(spark, sf_dir).select("title", "url", F.col("seen").alias("published"), "n_chars")
    return shown(landing.given(rows), "title", "url", "published", "summary", "source_type", "is_official")


@query(f"WITH {_STORED} SELECT event_id, event_date::VARCHAR AS event_date, CASE WHEN ticker = 'T03' AND year(event_date) = 1997 THEN 15 ELSE max_impact END AS max_impact FROM s")
def store_saved(spark, sf_dir):
    """The event table saved, and one partition saved again with other scores; the others stay (SK1)."""
    path = folder(spark)
    events = stored_events(spark, sf_dir)
    store.save(events, path)
    store.save(events.filter("scope = 'T03' and year = 1997").withColumn("max_impact", F.lit(15)), path)
    return spark.read.parquet(path).select("event_id", F.col("event_date").cast("string").alias("event_date"), "max_impact")


@query(f"WITH {_STORED} SELECT event_id, year(event_date)::INTEGER AS run_date FROM s WHERE year(event_date) <> 1996 OR max_impact >= 6")
def store_days(spark, sf_dir):
    """Snapshots by day; the second of a day replaces the first (SK2, SK4)."""
    path = folder(spark)
    events = stored_events(spark, sf_dir).select("event_id", "max_impact", F.col("year").alias("run_date"))
    store.save_day(events, path)
    store.save_day(events.filter("run_date = 1996 and max_impact >= 6"), path)
    return spark.read.parquet(path).select("event_id", F.col("run_date").cast("int").alias("run_date"))


@query(f"WITH {_STORED} SELECT event_id, ticker AS tickers, kind AS event_types, cluster_key, max_impact FROM s ORDER BY event_id")
def store_index(spark, sf_dir):
    """The store's index in order of its ids (SK3)."""
    return store.index(stored_events(spark, sf_dir)).select("event_id", F.array_join("tickers", ",").alias("tickers"), F.array_join("event_types", ",").alias("event_types"), "cluster_key", "max_impact")


@query(f"""WITH {PAIRS}, t AS (SELECT event_id, max(impact_score) AS m FROM p GROUP BY event_id)
    SELECT count(*) AS events, count(*) FILTER (m >= {report.MIN_IMPACT}) AS relevant, count(*) FILTER (m >= {report.HIGH}) AS high, count(*) FILTER (m >= {report.CRITICAL}) AS critical FROM t""")
def report_saved(spark, sf_dir):
    """A report table saved and read (SK5)."""
    path = folder(spark)
    report.save({"run_stats": report.run_stats(pairs(spark, sf_dir))}, path)
    return spark.read.parquet(f"{path}/run_stats")
