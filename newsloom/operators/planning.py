"""Searches, enrichment, analysis requests, alerts and backfill (QG1-QG5, EN1-EN3, AI1-AI3, AL1, BF1, TX18-TX20)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import text

# Kinds of searches in the order in which they are filled, and their quotas.
QUOTAS = {"COMPANY": 5, "EXTRA": 6, "SECTOR": 4, "INTERNATIONAL": 4, "COMMODITY": 3, "REGULATORY": 2, "COMPETITOR": 2, "CUSTOMER": 1, "SUPPLIER": 1, "PRODUCT": 1, "MACRO": 1}
MODIFIERS = ["order", "results", "expansion", "contract"]
#: From which list of a profile each kind takes how many terms, and what is written after the term.
SOURCES = [("SECTOR", "sector_topics", 8, ""), ("PRODUCT", "products", 4, "country"), ("INTERNATIONAL", "international_topics", 8, ""), ("COMMODITY", "commodities", 5, "price"), ("MACRO", "currencies", 1, "rupee"), ("MACRO", "macro_topics", 3, ""), ("REGULATORY", "regulators", 3, "industry"), ("REGULATORY", "government_dependencies", 2, ""), ("COMPETITOR", "competitors", 4, ""), ("CUSTOMER", "customers", 2, "industry"), ("SUPPLIER", "suppliers", 2, ""), ("EXTRA", "queries_extra", 99, "")]
BUDGET = 26
# Kinds whose terms are quoted, and exchanges that are no search of their own.
QUOTED, EXCHANGES = ["COMPANY", "COMPETITOR", "CUSTOMER", "SUPPLIER"], ["NSE", "BSE", "SEBI"]


def quoted(term: Column) -> Column:
    return F.when(F.contains(F.trim(term), F.lit(" ")), F.concat(F.lit('"'), term, F.lit('"'))).otherwise(F.trim(term))


def candidates(profiles: DataFrame, lists: DataFrame) -> DataFrame:
    """(ticker, kind, ord, text, term): every search a profile could ask (QG1). ``profiles`` has ticker, company,
    industry, country; ``lists`` ticker, field, pos, term."""
    named = profiles.select("ticker", F.posexplode(F.array(F.lit(""), *[F.lit(m) for m in MODIFIERS])).alias("ord", "modifier"), F.col("company").alias("term"))
    own = named.select("ticker", F.lit("COMPANY").alias("kind"), "ord", F.trim(F.concat_ws(" ", quoted(F.col("term")), "modifier")).alias("text"), "term")
    plan = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("field"), F.lit(n).alias("take"), F.lit(a).alias("after"), F.lit(100 * (i + 1)).alias("base")) for i, (k, f, n, a) in enumerate(SOURCES)])
    rows = lists.join(profiles.select("ticker", "industry", "country"), "ticker").withColumn("p", F.explode(F.filter(plan, lambda p: p["field"] == F.col("field"))))
    rows = rows.filter((F.col("pos") < F.col("p.take")) & ~((F.col("field") == "regulators") & F.upper("term").isin(EXCHANGES)))
    after = F.when(F.col("p.after") == "industry", F.coalesce("industry", F.lit(""))).when(F.col("p.after") == "country", F.coalesce("country", F.lit(""))).otherwise(F.col("p.after"))
    term = F.when(F.col("p.kind").isin(QUOTED), quoted(F.col("term"))).otherwise(F.col("term"))
    more = rows.select("ticker", F.col("p.kind").alias("kind"), (F.col("p.base") + F.col("pos")).alias("ord"), F.trim(F.regexp_replace(F.concat_ws(" ", term, after), r"\s+", " ")).alias("text"), "term")
    every = own.unionByName(more).filter("text <> ''")
    return every.groupBy("ticker", "kind", F.lower("text").alias("_low")).agg(F.min("ord").alias("ord"), F.min_by("text", "ord").alias("text"), F.min_by("term", "ord").alias("term")).drop("_low")


def allocate(searches: DataFrame, quotas: dict[str, int] = QUOTAS, budget: int = BUDGET) -> DataFrame:
    """The searches within a company's budget: quotas in order of kind, then what is left in that order (QG2)."""
    order = F.array(*[F.lit(k) for k in quotas])
    table = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    ranked = searches.withColumns({"kind_ord": F.array_position(order, F.col("kind")), "n": F.row_number().over(Window.partitionBy("ticker", "kind").orderBy("ord", "text"))}).filter("kind_ord > 0")
    beyond = F.col("n") > F.element_at(table, F.col("kind"))
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(beyond, "kind_ord", "n"))).filter(F.col("place") <= budget).drop("kind_ord", "n")


def flatten(searches: DataFrame) -> DataFrame:
    """One owner for each text whatever its case: the first company by name, its first search (QG3)."""
    rows = F.struct(*[F.col(c) for c in searches.columns])
    return searches.groupBy(F.lower("text").alias("_low")).agg(F.min_by(rows, F.struct("ticker", "place")).alias("r")).select("r.*")


def with_locales(searches: DataFrame, locales: DataFrame, most: int = 3) -> DataFrame:
    """Searches as they are (locale null), and up to ``most`` more a company in its further locales, for those
    about companies (QG4). ``locales`` has ticker, locale, pos."""
    like = searches.filter(F.col("kind").isin("COMPANY", "COMPETITOR", "CUSTOMER", "SUPPLIER"))
    more = like.join(locales, "ticker").withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy("place", "pos"))).filter(F.col("n") <= most)
    return searches.withColumn("locale", F.lit(None).cast("string")).unionByName(more.select(*searches.columns, "locale"))


def round_robin(terms: DataFrame, most: int) -> DataFrame:
    """The first terms of all companies, then the second ones, up to a number (QG5)."""
    return terms.orderBy("pos", "ticker", "term").limit(most)


def enrich(manual: DataFrame, found: DataFrame) -> DataFrame:
    """Found terms after manual ones, where they are absent whatever their case (EN1)."""
    low = lambda df: df.withColumn("_low", F.lower("term"))
    absent = low(found).join(low(manual).select("ticker", "field", "_low"), ["ticker", "field", "_low"], "left_anti")
    once = absent.groupBy("ticker", "field", "_low").agg(F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos")).drop("_low")
    last = manual.groupBy("ticker", "field").agg(F.max("pos").alias("last"))
    moved = once.join(last, ["ticker", "field"], "left").select("ticker", "field", (F.coalesce("last", F.lit(-1)) + 1 + F.col("pos")).alias("pos"), "term", F.lit("enriched").alias("source"))
    return manual.select("ticker", "field", "pos", "term", F.lit("manual").alias("source")).unionByName(moved)


# How pages say whom a company deals with.
FACTS = {
    "customers": [r"(?:our|key|major) (?:customers|clients) (?:include|are) ([^.]{4,300})"],
    "suppliers": [r"(?:our|key|major) suppliers (?:include|are) ([^.]{4,300})", r"sourced? from ([^.]{4,200})"],
    "products": [r"(?:we (?:make|manufacture|produce)|products include) ([^.]{4,300})"],
    "export_markets": [r"exports? to ([^.]{4,200})"],
}


def page_facts(pages: DataFrame, known: DataFrame, most: int | None = 25) -> DataFrame:
    """(ticker, field, term): names that a company's pages give, of 4 characters and at most six words, that
    are not known yet (EN2, TX20). ``pages`` has ticker, text; without ``most`` all names of a field are given."""
    parts = [F.struct(F.lit(field).alias("field"), F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(f"(?i){p}"), F.lit(1)) for p in patterns])).alias("found")) for field, patterns in FACTS.items()]
    found = pages.select("ticker", F.explode(F.array(*parts)).alias("f")).select("ticker", "f.field", F.explode("f.found").alias("line"))
    terms = found.select("ticker", "field", F.explode(F.split("line", r"\s*(?:,|;|\||\band\b)\s*")).alias("term")).withColumn("term", F.trim("term"))
    good = terms.filter((F.length("term") >= 4) & (F.size(F.split("term", r"\s+")) <= 6)).withColumn("low", F.lower("term"))
    new = good.groupBy("ticker", "field", "low").agg(F.min("term").alias("term"), F.count("*").alias("n")).join(known.select("ticker", "field", F.lower("term").alias("low")), ["ticker", "field", "low"], "left_anti")
    if most is not None:
        new = new.withColumn("place", F.row_number().over(Window.partitionBy("ticker", "field").orderBy(F.desc("n"), "low"))).filter(F.col("place") <= most)
    return new.select("ticker", "field", "term")


def stale(profiles: DataFrame, enriched: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Companies whose enrichment is absent, undated or old (EN3)."""
    last = enriched.groupBy("ticker").agg(F.max("enriched_on").alias("on"))
    return profiles.select("ticker").join(last, "ticker", "left").filter(F.col("on").isNull() | (F.datediff(today, "on") >= days)).select("ticker")


def select_for_analysis(pairs: DataFrame, most: int = 12, least: int = 9) -> DataFrame:
    """What is worth an analysis: strong, or indirect with much evidence (AI1). ``pairs`` has n_exposures."""
    indirect = F.col("relationship").startswith("INDIRECT") & (F.col("n_exposures") >= 3) & (F.col("impact_score") >= least - 3)
    return pairs.filter((F.col("impact_score") >= least) | indirect).orderBy(F.desc("impact_score"), F.desc("confidence"), "event_id", "ticker").limit(most)


def prompts(pairs: DataFrame) -> DataFrame:
    """(event_id, ticker, prompt) from an event's fields (AI2)."""
    lines = F.concat_ws("\n", F.format_string("Company: %s", "ticker"), F.format_string("Event: %s", "title"), F.format_string("Relationship: %s (impact %d/15, direction %s)", "relationship", "impact_score", "direction"), F.concat(F.lit("Exposures: "), F.array_join(F.transform("exposures", lambda e: F.concat(F.lower(e["exposure_type"]), F.lit(" - "), e["term"])), "; ")), F.lit("Answer in JSON. Give no investment advice."))
    return pairs.select("event_id", "ticker", lines.alias("prompt"))


#: What an answer may hold.
ANSWER = "struct<summary:string,why_it_matters:string,mechanism:string,horizon:string,confidence:string,risks:array<string>,opportunities:array<string>,watch:array<string>,unknowns:array<string>,counter:string>"


@F.pandas_udf(T.StringType())
def balanced_json(texts: pd.Series) -> pd.Series:
    """The first complete object of a chatty text, null if none (TX18)."""

    def first(value):
        at = (value or "").find("{")
        while at >= 0:
            try:
                found, _ = json.JSONDecoder().raw_decode(value, at)
                return json.dumps(found) if isinstance(found, dict) else None
            except ValueError:
                at = value.find("{", at + 1)
        return None

    return texts.map(first)


def answers(raw: DataFrame, most_chars: int = 1200, most_items: int = 5) -> DataFrame:
    """(event_id, ticker, answer, outcome): known keys only, advice redacted and items with it dropped (TX19, AI3)."""
    parsed = raw.withColumn("a", F.from_json(balanced_json("answer"), ANSWER))
    line = lambda c: F.substring(text.redact_advice(c), 1, most_chars)
    keep = lambda c: F.slice(F.filter(c, lambda i: i.isNotNull() & ~F.regexp_like(i, F.lit(text.advice_pattern()))), 1, most_items)
    lists, words = ["risks", "opportunities", "watch", "unknowns"], ["summary", "why_it_matters", "mechanism", "horizon", "confidence", "counter"]
    clean = F.struct(*[line(F.col(f"a.{w}")).alias(w) for w in words], *[keep(F.col(f"a.{w}")).alias(w) for w in lists])
    return parsed.select("event_id", "ticker", F.when(F.col("a").isNotNull(), clean).alias("answer"), F.when(F.col("a").isNotNull(), "enriched").otherwise("error").alias("outcome"))


def alerts(pairs: DataFrame, least: int) -> DataFrame:
    """Rows to be told about: strong ones, official ones a little sooner (AL1)."""
    return pairs.filter((F.col("impact_score") >= least) | (F.col("has_official") & (F.col("impact_score") >= least - 3)))


def slices(since: Column, until: Column, days: int) -> Column:
    """Contiguous stretches of days [since, until), the last one short (BF1)."""
    starts = F.sequence(since, F.date_sub(until, 1), F.make_dt_interval(days=F.lit(days)))
    return F.transform(starts, lambda s: F.struct(s.alias("since"), F.least(F.date_add(s, days), until).alias("until")))


def merge_slices(pairs: DataFrame) -> DataFrame:
    """Rows of events of many slices (``slice_no``): an event found in several has the rows of the last one (BF2)."""
    last = pairs.groupBy("event_id").agg(F.max("slice_no").alias("slice_no"))
    return pairs.join(last, ["event_id", "slice_no"], "left_semi")


def slice_totals(slices: DataFrame) -> DataFrame:
    """Articles scanned and unique ones, over all slices (BF2)."""
    return slices.agg(F.coalesce(F.sum("articles_scanned"), F.lit(0)).alias("articles_scanned"), F.coalesce(F.sum("unique_articles"), F.lit(0)).alias("unique_articles"))
