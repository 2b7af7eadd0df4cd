"""The daily job: from landed articles to scored events, the store and report tables."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text, urls
from newsloom.operators import cluster, dedup, direction, graph, impact, isolation, lexicon, normalize, report, store, wording

FLAGS = ["speculative", "opinion", "routine_release", "market_chatter", "listing_page", "recruitment", "research_report"]


#: The fields of a landed payload.
PAYLOAD = "summary string, source_name string, source_type string, is_official boolean"


def address(url: str) -> str:
    """A URL as it is, if it has a host and a port that can be read; raises otherwise."""
    parts = urlsplit(url.strip())
    if parts.port == 0 or not parts.hostname:
        raise ValueError("no host")
    return url


def isolated(landed: DataFrame, most: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(articles, diagnostics (article_id, place, stage, reason)) of landed rows: article_id, title, url, ``published`` as
    text and ``payload`` as JSON (RL10). Rows that raise in a date, in JSON, in a title or in a URL are named and left out;
    what the other rows give does not depend on them. Further columns stay."""
    steps = [
        isolation.parsed("json", "_payload", F.col("payload"), PAYLOAD), isolation.dated("date", "published", F.col("published")),
        isolation.encoded("title", "title", F.col("title")), isolation.tried("url", "url", address, "string", F.col("url")),
    ]
    good, failures = isolation.separate(isolation.examine(landed, steps), "article_id", most)
    fields = {
        "summary": F.coalesce("_payload.summary", F.lit("")), "source_name": F.col("_payload.source_name"),
        "source_type": F.coalesce("_payload.source_type", F.lit("unknown")), "is_official": F.coalesce("_payload.is_official", F.lit(False)),
    }
    return good.withColumns(fields | {"source_domain": urls.domain_of(F.col("url"))}).drop("_payload", "payload"), failures


def earlier_flags(events: DataFrame, stored: DataFrame, sources: DataFrame, markers: dict[str, list[str]]) -> DataFrame:
    """(cluster_id, flags) of each headline that the stored event which a new one continues has had (CL8). ``sources`` has
    event_id and title of the store's sources."""
    found = store.find_existing(events, stored).join(events.select(F.col("event_id").alias("incoming_id"), "cluster_id"), "incoming_id").select("event_id", "cluster_id")
    heads = sources.join(found, "event_id").filter("title <> ''").select("cluster_id", text.fold(F.col("title")).alias("head_f")).withColumn("text_f", F.col("head_f"))
    flagged = lexicon.flags(heads, {n: markers.get(n, []) for n in FLAGS if markers.get(n)})
    return flagged.select("cluster_id", *[F.col(n) if markers.get(n) else F.lit(False).alias(n) for n in FLAGS])


def assess(facts: DataFrame, links: DataFrame, stored: DataFrame | None = None, sources: DataFrame | None = None, markers: dict[str, list[str]] | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """Events with a row for each company: relationship, impact, direction, confidence, horizon and reasons.

    ``facts`` are articles with title, summary, url, published, source_type, source_domain, is_official, head_f, text_f,
    categories and flags; ``links`` what ``relationship.links`` returns. Links are written before clustering,
    which goes over them more than once. With ``stored`` events, their ``sources`` and the flags' ``markers``, headlines of
    earlier runs vote on a story's flags; ``profiles`` (ticker, industry) say who lends. No event is an update here:
    a story that goes on is merged into the stored one (``upsert``) and is not scored a second time."""
    links = graph.written(links)
    missing = {f: F.lit(False) for f in [*FLAGS, "legal_notice", "official_language"] if f not in facts.columns}
    facts = facts.withColumns(missing).withColumn("source_name", F.coalesce("source_name", "source_domain") if "source_name" in facts.columns else F.col("source_domain"))
    rows = graph.written(cluster.prepared(facts, links))
    members = graph.written(rows.drop("text_f").join(cluster.cluster(rows), "article_id"))
    events = cluster.with_ids(cluster.events(members))
    before = earlier_flags(events, stored, sources, markers or {}) if stored is not None and sources is not None else None
    flags = cluster.suppressive_flags(members, FLAGS, before)
    spoken = members.groupBy("cluster_id").agg(F.bool_or("official_language").alias("official_language"))
    strongest = graph.written(cluster.strongest_links(members, links).select("cluster_id", "ticker", "relationship", "rank", "evidence_weight", "international", "in_headline", "exposures", F.col("reasons").alias("link_reasons")))
    # a cluster is named by its first article, whose texts are asked once and not for each company
    first = rows.select(F.col("article_id").alias("cluster_id"), "head_f", "text_f").join(members.select("cluster_id"), "cluster_id", "left_semi").dropDuplicates(["cluster_id"])
    first = graph.written(wording.worded(first))
    asked = strongest.select("cluster_id", direction.anchor_term().alias("_anchor")).filter("_anchor is not null").distinct()
    placed = wording.anchored(asked.join(first.filter(wording.torn("head") | wording.torn("body")), "cluster_id"), F.col("_anchor")).select("cluster_id", "_anchor", "w_head_at", "w_body_at")
    kinds = events.select("event_id", "cluster_id", "title", "event_date", F.col("event_types").alias("categories"), F.array_distinct(F.transform("sources", lambda s: s["source_type"])).alias("source_types"), F.col("source_count").cast("int").alias("n_sources"), "has_official")
    both = strongest.join(kinds, "cluster_id").join(flags, "cluster_id").join(spoken, "cluster_id").join(first, "cluster_id")
    both = both.withColumn("_anchor", direction.anchor_term()).join(placed, ["cluster_id", "_anchor"], "left").drop("_anchor")
    lenders = profiles.select("ticker", F.regexp_like(F.lower("industry"), F.lit("bank|financial")).alias("is_lender")) if profiles is not None else None
    both = both.join(lenders, "ticker", "left") if lenders is not None else both.withColumn("is_lender", F.lit(False))
    both = both.withColumns({"is_international": F.col("international"), "is_update": F.lit(False), "is_lender": F.coalesce("is_lender", F.lit(False))})
    scored = direction.with_direction(impact.scored(both))
    value = impact.confidence(F.col("source_types"), F.col("n_sources"), F.col("rank"), F.col("w_major"), F.col("speculative"), F.col("opinion"))
    impacts = impact.business_impacts(F.col("categories"))
    out = scored.withColumns({"confidence": value, "horizon": impact.time_horizon(F.col("categories"), F.col("relationship")), "impacts": impacts, "watch_next": impact.watch_next(F.col("categories"))})
    out = out.withColumn("why", impact.why_it_matters(F.col("relationship"), F.col("categories"), F.col("impacts")))
    return out.drop(*wording.COLUMNS, "w_head_at", "w_body_at")


def fresh_articles(landed: DataFrame, seen: DataFrame, domains: DataFrame, now, hours: int = 36) -> DataFrame:
    """Normalised articles of the window, each once, that no earlier run saw. Normalised articles are written, as
    every pass of de-duplication reads them again."""
    recent = graph.written(normalize.lookback(normalize.normalize(landed, domains), now, hours))
    return dedup.split_seen(dedup.deduplicate(recent), seen)[0]


def upsert(incoming: DataFrame, stocks: DataFrame, events: DataFrame, event_stocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store's event and company tables after a run (ES1-ES4)."""
    found = graph.written(store.find_existing(incoming, events))
    merged = store.merge_stocks(stocks, event_stocks, found).drop("log")
    own = stocks.join(found.select(F.col("incoming_id").alias("event_id")), "event_id", "left_anti").select(*merged.columns)
    return store.merge_events(incoming, events, found), merged.unionByName(own)


def report_tables(pairs: DataFrame, profiles: DataFrame, signals: DataFrame | None = None) -> dict[str, DataFrame]:
    """All report tables; ``signals`` are the consumer signals of all days, if there are any."""
    tables = {"consumer": report.consumer(signals)} if signals is not None else {}
    return tables | {"header": report.header(pairs), "attention": report.attention(pairs), "dashboard": report.dashboard(pairs, profiles), "international": report.international(pairs), "cross_stock": report.cross_stock(pairs), "run_stats": report.run_stats(pairs)}
