"""Articles: normalisation, source type and quality, filters and splits (NM7-NM9, FL1-FL3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import dates, text, urls

# How far each type of source is trusted, out of 10; others 3.
QUALITY = {"exchange_filing": 10, "regulator": 10, "company_ir": 10, "wire": 9, "financial_press": 8, "newspaper": 7, "trade_publication": 6, "unknown": 3, "blog": 2, "social": 1}
# Types whose items are official.
OFFICIAL_TYPES = ["exchange_filing", "regulator", "company_ir"]
SUMMARY_CHARS = 1200


def quality_of(source_type: Column, quality: dict[str, int] = QUALITY) -> Column:
    table = F.create_map(*[F.lit(x) for pair in quality.items() for x in pair])
    return F.coalesce(F.element_at(table, source_type), F.lit(3))


def with_source_type(articles: DataFrame, domains: DataFrame) -> DataFrame:
    """``source_type`` by the longest suffix of ``source_domain`` in ``domains`` (domain, type), where it
    is unknown or absent. Distinct domains meet the table, not articles."""
    some = articles.select("source_domain").distinct()
    tried = some.select("source_domain", F.posexplode(urls.suffixes(F.col("source_domain"))).alias("cut", "domain"))
    found = tried.join(domains.select("domain", "type"), "domain").groupBy("source_domain").agg(F.min_by("type", "cut").alias("found"))
    old = F.col("source_type") if "source_type" in articles.columns else F.lit("unknown")
    return articles.join(found, "source_domain", "left").withColumn("source_type", F.when(F.coalesce(old, F.lit("unknown")) != "unknown", old).otherwise(F.coalesce("found", F.lit("unknown")))).drop("found")


def normalize(articles: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Clean titles, summaries and URLs; publisher and domain; source type; official flag; identity.
    Rows without a title or a URL go (NM7)."""
    raw = text.clean_text(F.col("title"))
    out = articles.withColumns({"publisher": text.publisher_of(raw), "title": text.headline_of(raw)})
    out = out.withColumns({"summary": F.substring(text.clean_text(F.col("summary")), 1, SUMMARY_CHARS), "url": urls.canonical_url(F.col("url"))})
    domain = urls.domain_of(F.col("url"))
    out = out.withColumn("source_domain", F.when(domain != "", domain).otherwise(F.col("source_domain")))
    name = F.when(F.coalesce(F.col("source_name"), F.lit("")) != "", F.col("source_name")).when(F.col("publisher") != "", F.col("publisher")).otherwise(F.col("source_domain"))
    out = out.withColumn("source_name", name).drop("publisher")
    if domains is not None:
        out = with_source_type(out, domains)
    out = out.withColumn("is_official", F.coalesce("is_official", F.lit(False)) | F.col("source_type").isin(OFFICIAL_TYPES))
    out = out.withColumn("article_id", text.stable_id(F.col("source_domain"), text.normalize_title(F.col("title")), separator="|"))
    return out.filter((F.col("title") != "") & (F.col("url") != ""))


def lookback(articles: DataFrame, now: Column, hours: int = 36) -> DataFrame:
    return articles.filter(dates.within_lookback(F.col("published"), now, hours))


def split_consumer(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(consumer posts, news): posts are one for each address, the first by article_id; blank addresses stay (FL2)."""
    news = articles.filter(~F.coalesce("consumer", F.lit(False)))
    posts = articles.filter(F.coalesce("consumer", F.lit(False)))
    key = F.lower(F.coalesce("url", F.lit("")))
    first = posts.filter(key != "").withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("article_id"))).filter("n = 1").drop("n")
    return first.unionByName(posts.filter(key == "")), news


def normalize_tickers(wanted: DataFrame, profiles: DataFrame, aliases: DataFrame) -> DataFrame:
    """(input, ticker, known) of (input): exact, by alias, then both without blanks, dots and dashes (FL3).
    ``profiles`` has ticker, ``aliases`` (alias, ticker)."""
    up = F.upper(F.trim("input"))
    compact = lambda c: F.regexp_replace(c, r"[ .\-]", "")
    names = profiles.select(F.col("ticker").alias("key"), "ticker", F.lit(0).alias("step"))
    also = aliases.select(F.upper("alias").alias("key"), "ticker", F.lit(1).alias("step"))
    table = names.unionByName(also)
    tried = wanted.select("input", F.explode(F.array(F.struct(up.alias("key"), F.lit(0).alias("form")), F.struct(compact(up).alias("key"), F.lit(1).alias("form")))).alias("t")).select("input", "t.*")
    best = tried.join(table, "key", "left").groupBy("input").agg(F.min(F.when(F.col("ticker").isNotNull(), F.struct("form", "step", "ticker"))).alias("b"))
    return best.select("input", F.coalesce("b.ticker", F.upper(F.trim("input"))).alias("ticker"), F.col("b").isNotNull().alias("known"))


def profile_aliases(profiles: DataFrame) -> DataFrame:
    """(ticker, alias, is_primary): the company's name first if it is no alias yet, each alias once
    whatever its case, blanks dropped (PF1). ``profiles`` has ticker, company, aliases array of (value, strength)."""
    given = profiles.select("ticker", F.posexplode("aliases").alias("pos", "a")).select("ticker", (F.col("pos") + 1).alias("pos"), F.trim("a.value").alias("alias"), (F.coalesce("a.strength", F.lit("primary")) == "primary").alias("is_primary"))
    named = profiles.select("ticker", F.lit(0).alias("pos"), F.trim("company").alias("alias"), F.lit(True).alias("is_primary"))
    lows = given.select("ticker", F.lower("alias").alias("low"))
    absent = named.withColumn("low", F.lower("alias")).join(lows, ["ticker", "low"], "left_anti").drop("low")
    every = given.unionByName(absent).filter("alias <> ''")
    return every.withColumn("n", F.row_number().over(Window.partitionBy("ticker", F.lower("alias")).orderBy("pos"))).filter("n = 1").select("ticker", "alias", "is_primary", "pos")


# The exposure type that each list of a profile stands for (PF2).
LIST_TYPES = {"subsidiaries": "SUBSIDIARY", "associates": "SUBSIDIARY", "brands": "PRODUCT", "products": "PRODUCT", "services": "PRODUCT", "competitors": "COMPETITOR", "suppliers": "SUPPLIER", "customers": "CUSTOMER", "countries": "GEOGRAPHY", "export_markets": "GEOGRAPHY", "currencies": "CURRENCY", "regulators": "REGULATION", "government_dependencies": "REGULATION", "sector_topics": "INDUSTRY", "international_topics": "INDUSTRY", "macro_topics": "MACRO", "technologies": "TECHNOLOGY", "commodities": "COMMODITY"}


def profile_terms(lists: DataFrame) -> DataFrame:
    """Lexicon rows of (ticker, field, pos, term, role): the exposure type, and what the rules ask of a
    term; one row for each ticker, type and term whatever its case (PF2)."""
    table = F.create_map(*[F.lit(x) for pair in LIST_TYPES.items() for x in pair])
    rows = lists.withColumns({"exposure_type": F.element_at(table, F.col("field")), "term": F.trim("term")}).filter("exposure_type is not null and term <> ''")
    flag = lambda name: F.max(F.col("field") == name)
    return rows.groupBy("ticker", "exposure_type", F.lower("term").alias("low")).agg(
        F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos"), F.max("role").alias("role"),
        flag("export_markets").alias("is_export_market"), flag("international_topics").alias("is_international"), flag("associates").alias("is_associate"),
    ).drop("low")


def isolate(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all checks, the others with ``reason``: the names of the checks that fail), so that a row that cannot
    be used is named and ends no job. A check that is null fails (RL10)."""
    failed = F.concat_ws("; ", *[F.when(~F.coalesce(passes, F.lit(False)), F.lit(name)) for name, passes in checks.items()])
    marked = rows.withColumn("reason", failed)
    return marked.filter("reason = ''").drop("reason"), marked.filter("reason <> ''")
