"""Report tables (RP1-RP13, DG1-DG2). ``pairs`` has a row for each event and company: event_id, ticker,
impact_score, confidence, direction, relationship, is_international, has_official, exposures, event_types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.relationship import has

MIN_IMPACT, WEAK_MIN, HIGH, CRITICAL = 5, 9, 8, 13
MOST_BLOCKS, MOST_CROSS, PER_SECTION, MOST_WATCH, THEME_MIN = 16, 8, 8, 5, 3
# Categories that put an event in the regulatory section.
REGULATORY = ["REGULATORY", "GOVERNMENT_POLICY", "TARIFF", "TRADE_POLICY", "EXPORT_RESTRICTION", "IMPORT_RESTRICTION"]


def reportable(pairs: DataFrame) -> DataFrame:
    """Weak links need more (RP1)."""
    return pairs.filter(F.col("impact_score") >= F.when(F.col("relationship") == "WEAK", WEAK_MIN).otherwise(MIN_IMPACT))


def header(pairs: DataFrame) -> DataFrame:
    """One row of counts (RP2)."""
    events = lambda when: F.count_distinct(F.when(when, F.col("event_id")))
    ok = F.col("impact_score") >= F.when(F.col("relationship") == "WEAK", WEAK_MIN).otherwise(MIN_IMPACT)
    return pairs.agg(
        F.count_distinct("event_id").alias("events"), events(ok).alias("relevant"), events(F.col("impact_score") >= HIGH).alias("high"), events(F.col("impact_score") >= CRITICAL).alias("critical"),
        events(F.col("is_international")).alias("international"), events(F.col("has_official")).alias("official"),
    )


def one_per_company(pairs: DataFrame) -> DataFrame:
    rows = F.struct(*[F.col(c) for c in pairs.columns])
    return pairs.groupBy(F.col("event_id").alias("_e"), F.col("ticker").alias("_t")).agg(F.max_by(rows, F.struct("impact_score", "confidence")).alias("r")).select("r.*")


def attention(pairs: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """(event_id, top_score, top_ticker, n_tickers) of the events to look at first (RP3)."""
    rows = one_per_company(pairs).filter(F.col("impact_score") >= HIGH)
    out = rows.groupBy("event_id").agg(F.max("impact_score").alias("top_score"), F.min_by("ticker", F.struct((-F.col("impact_score")).alias("s"), "ticker")).alias("top_ticker"), F.count("*").alias("n_tickers"))
    return out.orderBy(F.desc("top_score"), "event_id").limit(most)


def dashboard(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each company's events by direction, quiet companies with zeros (RP4)."""
    count = lambda name, kinds: F.sum(F.col("direction").isin(kinds).cast("int")).cast("long").alias(name)
    counted = reportable(pairs).groupBy("ticker").agg(F.count("*").alias("events"), count("positive", ["POSITIVE"]), count("negative", ["NEGATIVE"]), count("mixed", ["MIXED"]), count("unclear", ["UNCERTAIN", "NEUTRAL"]), F.max("impact_score").alias("top_score"))
    return profiles.select("ticker").join(counted, "ticker", "left").fillna(0)


def international(pairs: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """Foreign events and the companies they reach without naming them (RP5)."""
    rows = reportable(pairs).filter(F.col("is_international") & (F.col("relationship") != "DIRECT"))
    return rows.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("ticker")), ",").alias("tickers"), F.max("impact_score").alias("top_score")).orderBy(F.desc("top_score"), "event_id").limit(most)


def cross_stock(pairs: DataFrame, most: int = MOST_CROSS) -> DataFrame:
    """Events that reach several companies (RP6)."""
    rows = reportable(pairs).groupBy("event_id").agg(F.count_distinct("ticker").alias("n_tickers"), F.max("impact_score").alias("top_score")).filter("n_tickers > 1")
    return rows.orderBy(F.desc("top_score"), "event_id").limit(most)


def section_of() -> Column:
    """Where an event stands for a company, first rule first (RP7)."""
    kinds = F.transform("exposures", lambda e: e["exposure_type"])
    rival = F.array_contains(kinds, "COMPETITOR")
    ruled = has(F.col("event_types"), REGULATORY) | F.array_contains(kinds, "REGULATION")
    return (
        F.when(F.col("relationship") == "DIRECT", "direct").when(F.col("is_international") & rival, "competitor").when(F.col("is_international"), "international").when(ruled, "regulatory")
        .when(rival, "competitor").when(F.array_contains(kinds, "SUPPLIER") | F.array_contains(kinds, "CUSTOMER"), "chain").when(F.col("relationship") == "MACRO", "macro").otherwise("industry")
    )


def per_section(rows: DataFrame, most: int = PER_SECTION) -> DataFrame:
    """The first rows of each company and section (RP8); ``rows`` has a section."""
    order = Window.partitionBy("ticker", "section").orderBy(F.desc("impact_score"), F.desc("confidence"), "event_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def theme_of() -> Column:
    """The first commodity, else the first industry topic; null without (RP9)."""
    first = lambda kind: F.get(F.filter("exposures", lambda e: e["exposure_type"] == kind), F.lit(0))["term"]
    return F.coalesce(F.concat(F.lit("COMMODITY:"), F.lower(first("COMMODITY"))), F.concat(F.lit("INDUSTRY:"), F.lower(first("INDUSTRY"))))


def collapse_themes(rows: DataFrame, least: int = THEME_MIN) -> DataFrame:
    """Rows of one company and theme become the strongest and a number, where there are enough (RP9)."""
    themed = rows.filter("theme is not null")
    facts = themed.groupBy("ticker", "theme").agg(F.count("*").alias("size"), F.min_by("event_id", F.struct((-F.col("impact_score")).alias("s"), "event_id")).alias("best"))
    both = themed.join(facts, ["ticker", "theme"]).filter((F.col("size") < least) | (F.col("event_id") == F.col("best")))
    kept = both.withColumn("similar", F.when(F.col("size") >= least, F.col("size") - 1).otherwise(F.lit(0).cast("long"))).drop("size", "best")
    return kept.unionByName(rows.filter("theme is null").withColumn("similar", F.lit(0).cast("long")))


def watch_items(pairs: DataFrame, most: int = MOST_WATCH) -> DataFrame:
    """(ticker, item, place): the first different items over a company's ranked events (RP10). ``pairs`` has
    watch_next."""
    rank = F.struct((-F.col("impact_score")).alias("s"), (-F.col("confidence")).alias("c"), F.col("event_id"), F.col("pos"))
    first = pairs.select("ticker", "impact_score", "confidence", "event_id", F.posexplode("watch_next").alias("pos", "item")).groupBy("ticker", "item").agg(F.min(rank).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy("first", "item"))).filter(F.col("place") <= most).select("ticker", "item", "place")


def failure_reason(error: Column) -> Column:
    """What an error text says happened (RP12)."""
    low, code = F.lower(F.coalesce(error, F.lit(""))), F.regexp_extract(F.coalesce(error, F.lit("")), r"\b([45]\d{2})\b", 1)
    return F.when(code.isin("401", "403"), F.concat(code, F.lit(" Blocked"))).when(code == "404", "404 Not found").when(code == "429", "429 Rate limited").when(code != "", F.concat(F.lit("HTTP "), code)).when(F.regexp_like(low, F.lit("timed? ?out|timeout")), "Timeout").when(F.regexp_like(low, F.lit("resolve|unreachable|connection|refused")), "Unreachable").when(F.contains(low, F.lit("json")), "Not JSON").otherwise("")


def diagnostics(outcomes: DataFrame) -> DataFrame:
    """(source, status, reason, attempted, articles) of fetch outcomes."""
    status = F.when(F.col("skipped"), "skipped").when(F.col("ok"), "ok").otherwise("FAILED")
    return outcomes.select("source", status.alias("status"), failure_reason(F.get("errors", F.lit(0))).alias("reason"), "attempted", "articles")


def source_state(outcomes: DataFrame) -> DataFrame:
    """skipped, verified, no_data or failed (DG1), and whether the outcome counts as good (DG2)."""
    state = F.when(F.col("skipped"), "skipped").when(F.col("articles") > 0, "verified").when(F.col("succeeded") > 0, "no_data").otherwise("failed")
    return outcomes.select("source", state.alias("state"), ((F.col("succeeded") > 0) | F.col("skipped")).alias("good"))


def collapse_diagnostics(outcomes: DataFrame, most: int = 3) -> DataFrame:
    """One row for each source over many runs (BF3)."""
    errors = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("errors")))), 1, most)
    return outcomes.groupBy("source").agg(F.bool_or("ok").alias("ok"), F.sum("attempted").alias("attempted"), F.sum("succeeded").alias("succeeded"), F.sum("articles").alias("articles"), F.array_join(errors, "; ").alias("errors"))


def consumer(signals: DataFrame) -> DataFrame:
    """What consumers said of each company on a day, against the day before, and whether it is worth a look (RP11)."""
    from newsloom.operators.signals import with_previous

    return with_previous(signals).select("day", "ticker", "mentions", "positive", "negative", "neutral", "net", "leaning", "mention_change", "net_change", "notable")


def run_stats(pairs: DataFrame) -> DataFrame:
    """Events by what they reach (RP13)."""
    top = pairs.groupBy("event_id").agg(F.max("impact_score").alias("m"))
    at = lambda n: F.sum((F.col("m") >= n).cast("int")).cast("long")
    return top.agg(F.count("*").alias("events"), at(MIN_IMPACT).alias("relevant"), at(HIGH).alias("high"), at(CRITICAL).alias("critical"))


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Report tables as Parquet, one folder each (SK5)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
