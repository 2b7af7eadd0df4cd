"""Profiles, searches, hints, narratives, analysis requests, event merges, sliding windows and alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import cluster, graph, impact, match, normalize, planning, store
from newsloom.queries.article_queries import plain
from newsloom.queries.base import PAIRS, TEXTS, TICKERS, pairs, rows_of, table, texts
from newsloom.queries.event_queries import _ASSESSED, _STORED, _name, _stream, assessed, stored_events
from newsloom.streaming import streams

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


@query("""WITH g AS (SELECT 'C' || c_custkey AS ticker, unnest([1, 2, 3]) AS pos, unnest([lower(c_name), c_mktsegment, ' ' || upper(c_mktsegment) || ' ']) AS alias, unnest([true, false, true]) AS is_primary, c_custkey FROM customer),
    n AS (SELECT 'C' || c_custkey AS ticker, 0 AS pos, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Company ' || c_custkey END AS alias, true AS is_primary FROM customer),
    a AS (SELECT ticker, pos, trim(alias) AS alias, is_primary FROM g UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.ticker = n.ticker AND lower(trim(g.alias)) = lower(n.alias)))
    SELECT ticker, alias, is_primary FROM a QUALIFY row_number() OVER (PARTITION BY ticker, lower(alias) ORDER BY pos) = 1""")
def profile_aliases(spark, sf_dir):
    spec = lambda v, s: F.struct(v.alias("value"), F.lit(s).alias("strength"))
    given = F.array(spec(F.lower("c_name"), "primary"), spec(F.col("c_mktsegment"), "secondary"), spec(F.concat(F.lit(" "), F.upper("c_mktsegment"), F.lit(" ")), "primary"))
    company = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("Company "), F.col("c_custkey").cast("string")))
    profiles = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), company.alias("company"), given.alias("aliases"))
    return normalize.profile_aliases(profiles).drop("pos")


@query("""WITH l AS (SELECT 'N' || s_nationkey AS ticker, CASE s_suppkey % 4 WHEN 0 THEN 'suppliers' WHEN 1 THEN 'export_markets' WHEN 2 THEN 'countries' ELSE 'notes' END AS field, s_suppkey AS pos, CASE s_suppkey % 3 WHEN 0 THEN 'Peru' WHEN 1 THEN 'peru' ELSE 'Supplier ' || (s_suppkey % 7) END AS term FROM supplier),
    t AS (SELECT *, CASE field WHEN 'suppliers' THEN 'SUPPLIER' WHEN 'notes' THEN NULL ELSE 'GEOGRAPHY' END AS exposure_type FROM l)
    SELECT ticker, exposure_type, arg_min(term, pos) AS term, bool_or(field = 'export_markets') AS is_export_market FROM t WHERE exposure_type IS NOT NULL GROUP BY ticker, exposure_type, lower(term)""")
def profile_terms(spark, sf_dir):
    k = F.col("s_suppkey")
    field = F.when(k % 4 == 0, "suppliers").when(k % 4 == 1, "export_markets").when(k % 4 == 2, "countries").otherwise("notes")
    term = F.when(k % 3 == 0, "Peru").when(k % 3 == 1, "peru").otherwise(F.concat(F.lit("Supplier "), (k % 7).cast("string")))
    lists = table(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("ticker"), field.alias("field"), k.alias("pos"), term.alias("term"), F.lit(None).cast("string").alias("role"))
    return normalize.profile_terms(lists).select("ticker", "exposure_type", "term", "is_export_market")


@query("""WITH n AS (SELECT 'N' || n_nationkey AS ticker, n_name FROM nation), own AS (SELECT ticker, 'COMPANY' AS kind, trim(n_name || ' ' || m) AS text FROM n, (VALUES (''), ('order'), ('results'), ('expansion'), ('contract')) v(m)),
    s AS (SELECT 'N' || s_nationkey AS ticker, s_name AS term, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier),
    c AS (SELECT 'N' || c_nationkey AS ticker, c_mktsegment || ' goods' AS term, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer)
    SELECT ticker, kind, text FROM own UNION ALL SELECT ticker, 'SUPPLIER', term FROM s WHERE pos < 2 UNION ALL SELECT DISTINCT ticker, 'COMMODITY', term || ' price' FROM c WHERE pos < 5""")
def query_candidates(spark, sf_dir):
    from newsloom.operators.dedup import rank_in

    name = lambda c: F.concat(F.lit("N"), F.col(c).cast("string")).alias("ticker")
    profiles = table(spark, sf_dir, "nation").select(name("n_nationkey"), F.col("n_name").alias("company"), F.lit("").alias("industry"), F.lit("").alias("country"))
    makers = rank_in(table(spark, sf_dir, "supplier"), ["s_nationkey"], ["s_suppkey"], "n").select(name("s_nationkey"), F.lit("suppliers").alias("field"), (F.col("n") - 1).alias("pos"), F.col("s_name").alias("term"))
    goods = rank_in(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_custkey"], "n").select(name("c_nationkey"), F.lit("commodities").alias("field"), (F.col("n") - 1).alias("pos"), F.concat("c_mktsegment", F.lit(" goods")).alias("term"))
    return planning.candidates(profiles, makers.unionByName(goods)).select("ticker", "kind", "text")


@query(f"WITH {TEXTS} SELECT article_id, ticker FROM t WHERE is_official AND doc_id % 2 = 0")
def entity_hints(spark, sf_dir):
    rows = texts(spark, sf_dir).withColumns({"collector": F.lit("rss"), "tickers_hint": F.when(F.col("doc_id") % 2 == 0, F.array(F.lower("ticker"), F.lit("none"))).otherwise(F.array(F.lit("none")))})
    return match.hinted(rows, rows_of(spark, [(t,) for t in TICKERS], "ticker string")).select("article_id", "ticker")


_WATCH = {k: impact.WATCH.get(k) for k in ("ORDER_WIN", "EARNINGS", "REGULATORY", "TARIFF", "FRAUD")}


@query(f"WITH {_ASSESSED} SELECT event_id, CASE kind " + " ".join(f"WHEN '{k}' THEN '{'; '.join(v)}'" for k, v in _WATCH.items()) + f" ELSE '{impact.DEFAULT_WATCH}' END AS items FROM r")
def watch_next(spark, sf_dir):
    return assessed(spark, sf_dir).select("event_id", F.array_join(impact.watch_next(F.col("categories")), "; ").alias("items"))


_OPENING = "CASE relationship " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in impact.OPENINGS.items()) + " END"
_TOUCHED = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{', '.join(x.lower().replace('_', ' ') for x in v[:3])}'" for k, v in impact.IMPACTS.items()) + " END"


@query(f"WITH {_ASSESSED}, i AS (SELECT *, {_TOUCHED} AS touched FROM r) SELECT event_id, {_OPENING} || '.' || coalesce(' The parts of the business most likely touched are ' || touched || '.', '') || ' Classified as ' || lower(replace(kind, '_', ' ')) || '.' AS why FROM i")
def why_it_matters(spark, sf_dir):
    rows = assessed(spark, sf_dir)
    return rows.select("event_id", impact.why_it_matters(F.col("relationship"), F.col("categories"), impact.business_impacts(F.col("categories"))).alias("why"))


@query(f"WITH {PAIRS} SELECT row_id, 'Company: ' || ticker || chr(10) || 'Event: ' || event_type || chr(10) || 'Relationship: ' || relationship || ' (impact ' || impact_score || '/15, direction ' || direction || ')' || chr(10) || 'Exposures: commodity - coal' || chr(10) || 'Answer in JSON. Give no investment advice.' AS prompt FROM p WHERE impact_score >= 12")
def analysis_prompts(spark, sf_dir):
    rows = pairs(spark, sf_dir).filter("impact_score >= 12").withColumns({"title": F.col("event_type"), "exposures": F.array(F.struct(F.lit("COMMODITY").alias("exposure_type"), F.lit("coal").alias("term"))), "event_id": F.col("row_id").cast("string")})
    return planning.prompts(rows).select(F.col("event_id").cast("long").alias("row_id"), "prompt")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'enriched' WHEN 1 THEN 'enriched' ELSE 'error' END AS outcome, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'second' END AS summary FROM events")
def analysis_answers(spark, sf_dir):
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.concat(F.lit('Sure: ```json\n{"summary": "'), "event_type", F.lit('", "risks": []}\n``` done {x}'))).when(k == 1, '{bad} then {"summary": "second"}').otherwise("no object here")
    raw = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.lit("T").alias("ticker"), said.alias("answer"))
    return planning.answers(raw).select(F.col("event_id").cast("long").alias("event_id"), "outcome", F.col("answer.summary").alias("summary"))


@query("SELECT event_id, props AS found FROM events")
def first_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.first_json(F.concat(F.lit("note: ```json "), "props", F.lit(" ```"))).alias("found"))


@query(f"""WITH {_STORED}, o AS (SELECT * FROM s WHERE o_orderkey % 2 = 0), i AS (SELECT s.*, 'EVENT-T' || lpad((o_custkey % 11)::VARCHAR, 2, '0') AS x FROM s WHERE o_orderkey % 2 = 1),
    m AS (SELECT o.event_id AS target, i.* FROM i JOIN o ON o.o_orderkey = i.o_orderkey - 1)
    SELECT o.event_id, greatest(o.max_impact, coalesce(m.max_impact, 0)) AS max_impact, least(o.event_date, coalesce(m.event_date, o.event_date))::VARCHAR AS event_date, CASE WHEN m.kind IS NULL OR m.kind = o.kind THEN o.kind ELSE o.kind || ',' || m.kind END AS kinds, (o.o_orderkey % 5 = 0) OR coalesce(m.o_orderkey % 5 = 0, false) AS has_official FROM o LEFT JOIN m ON m.target = o.event_id
    UNION ALL SELECT event_id, max_impact, event_date::VARCHAR, kind, o_orderkey % 5 = 0 FROM i WHERE o_orderkey - 1 NOT IN (SELECT o_orderkey FROM o)""")
def event_merge(spark, sf_dir):
    events = stored_events(spark, sf_dir)
    old, new = events.filter("sequence % 2 = 0"), events.filter("sequence % 2 = 1")
    found = new.select(F.col("event_id").alias("incoming_id"), (F.col("sequence") - 1).alias("s")).join(old.select("event_id", F.col("sequence").alias("s")), "s").drop("s")
    out = store.merge_events(new, old, found)
    return out.select("event_id", "max_impact", F.col("event_date").cast("string").alias("event_date"), F.array_join("event_types", ",").alias("kinds"), "has_official")


_RANK = "CASE source_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cluster.RANKS.items()) + " ELSE 3 END"


@query(f"""WITH {TEXTS} SELECT (doc_id // 4)::VARCHAR AS cluster_id, arg_min(article_id, (NOT is_official, -({_RANK}), -length(title), doc_id % 4, article_id)) AS lead FROM t GROUP BY doc_id // 4""")
def cluster_leads(spark, sf_dir):
    number = F.col("article_id").cast("long")
    rows = plain(spark, sf_dir).withColumns({"cluster_id": F.floor(number / 4).cast("string"), "position": number % 4})
    return cluster.leads(rows).select("cluster_id", F.col("lead.article_id").alias("lead"))


@query("SELECT strftime(d, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS d FROM events) GROUP BY ALL")
def stream_sliding_counts(spark, sf_dir):
    out = streams.drained(streams.daily_counts(_stream(spark, sf_dir), ["event_type"], window="7 days", slide="1 day"), "complete", graph.shared_folder(spark), _name("sliding"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT event_id FROM events WHERE floor(value / 10) >= 12 OR (event_id % 5 = 0 AND floor(value / 10) >= 9)")
def stream_alerts(spark, sf_dir):
    folder = f"{graph.shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    rows = _stream(spark, sf_dir).select("event_id", F.floor(F.col("value") / 10).cast("int").alias("impact_score"), (F.col("event_id") % 5 == 0).alias("has_official"))

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    streams.alert_stream(rows, 12, put, f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("event_id")


@query("SELECT event_id, event_id % 10 = 0 AS undated FROM events")
def stream_undated(spark, sf_dir):
    dated, undated = streams.split_undated(table(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_id") % 10 != 0, F.col("ts"))))
    return dated.select("event_id", F.lit(False).alias("undated")).unionByName(undated.select("event_id", F.lit(True).alias("undated")))


@query(f"WITH {PAIRS}, l AS (SELECT *, row_id % 5 AS slice_no FROM p) SELECT event_id, ticker, row_id, slice_no FROM l QUALIFY slice_no = max(slice_no) OVER (PARTITION BY event_id)")
def backfill_merge(spark, sf_dir):
    """Events of many slices, each as the last slice found it (BF2)."""
    rows = pairs(spark, sf_dir).withColumn("slice_no", F.col("row_id") % 5)
    return planning.merge_slices(rows).select("event_id", "ticker", "row_id", "slice_no")


@query("SELECT sum(event_id % 100)::BIGINT AS articles_scanned, sum(event_id % 60)::BIGINT AS unique_articles FROM events")
def backfill_totals(spark, sf_dir):
    """What all slices scanned (BF2)."""
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 100).alias("articles_scanned"), (F.col("event_id") % 60).alias("unique_articles"))
    return planning.slice_totals(rows)
