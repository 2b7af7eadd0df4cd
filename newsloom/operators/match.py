"""Entities and exposures of companies in articles (EM1-EM6, EX1-EX4), as lexicon joins.

``texts`` has article_id, text_f, head_f (folded), collector, is_official and tickers_hint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import lexicon, phrases
from newsloom.operators.graph import written

# Collectors that fetch by company, so that their hint is known to be right.
TRUSTED = ["nse", "bse", "company_ir"]
# Weight and relationship of each exposure type, and the order of relationships.
WEIGHTS = {"SUBSIDIARY": 3.0, "CUSTOMER": 2.0, "SUPPLIER": 2.0, "COMPETITOR": 2.0, "COMMODITY": 2.0, "REGULATION": 1.8, "INDUSTRY": 1.5, "PRODUCT": 1.2, "TECHNOLOGY": 1.0, "MACRO": 1.0, "CURRENCY": 0.8, "GEOGRAPHY": 0.4, "COMPANY": 4.0}
RELATIONSHIPS = ["WEAK", "MACRO", "SECTOR", "INDIRECT", "INDIRECT_STRONG", "DIRECT"]
BASE = {"COMPANY": "DIRECT", "SUBSIDIARY": "DIRECT", "PRODUCT": "SECTOR", "CUSTOMER": "INDIRECT", "SUPPLIER": "INDIRECT", "COMPETITOR": "INDIRECT", "INDUSTRY": "SECTOR", "COMMODITY": "INDIRECT", "CURRENCY": "MACRO", "REGULATION": "INDIRECT", "GEOGRAPHY": "WEAK", "MACRO": "MACRO", "TECHNOLOGY": "SECTOR"}
GENERIC_PLACES = ["india", "asia", "europe", "world", "global"]
PER_TYPE = 4


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def rank_of(relationship: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RELATIONSHIPS]), relationship).cast("int") - 1


def relationship_of(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(r) for r in RELATIONSHIPS]), rank)


SIDES = ("marks_text_f", "marks_head_f")


def alias_hits(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every alias that occurs in a text with ``reason``: null if it counts, else why not (EM2, EM5).
    ``aliases`` has ticker, alias, is_primary, requires, excludes (with the company's negative aliases)."""
    found = lexicon.hits(texts, aliases, "article_id", "text_f", "alias", keep=SIDES, also=("requires", "excludes"))
    alias = text.fold(F.col("alias"))
    inside = (F.size("excludes") > 0) & ~phrases.occurs_outside(F.col("marks_text_f"), alias, phrases.folded_all(F.col("excludes")))
    lacks = (F.size("requires") > 0) & ~phrases.occurs_any(F.col("marks_text_f"), phrases.folded_all(F.col("requires")))
    reason = F.when(inside, "alias appears only inside an excluded phrase").when(lacks, "required context term absent")
    return found.select("article_id", "ticker", "alias", "is_primary", phrases.occurs(F.col("marks_head_f"), alias).alias("in_headline"), reason.alias("reason"))


def free(texts: DataFrame, terms: DataFrame, column: str) -> DataFrame:
    """Terms that occur in a text outside of their excluded phrases (EX2), with ``in_headline``."""
    found = lexicon.hits(texts, terms, "article_id", "text_f", column, keep=SIDES, also=("excludes",))
    term = text.fold(F.col(column))
    outside = (F.size("excludes") == 0) | phrases.occurs_outside(F.col("marks_text_f"), term, phrases.folded_all(F.col("excludes")))
    return found.filter(outside).withColumn("in_headline", phrases.occurs(F.col("marks_head_f"), term)).drop(*SIDES)


def rejections(hits: DataFrame) -> DataFrame:
    return hits.filter("reason is not null").select("article_id", "ticker", "alias", "reason")


def hinted(texts: DataFrame, tickers: DataFrame) -> DataFrame:
    """Hints of collectors that know, as headline matches (EM1)."""
    rows = texts.filter(F.col("collector").isin(TRUSTED) | F.col("is_official")).select("article_id", F.explode(F.array_distinct("tickers_hint")).alias("hint"))
    return rows.withColumn("ticker", F.upper("hint")).join(tickers.select("ticker").distinct(), "ticker").select("article_id", "ticker", F.col("ticker").alias("alias"), F.lit("primary").alias("strength"), F.lit(True).alias("in_headline"))


def entities(texts: DataFrame, aliases: DataFrame, names: DataFrame) -> DataFrame:
    """(article_id, ticker, alias, strength, in_headline): each company's best mention (EM1-EM6): a trusted
    hint; else the best alias (primary, headline, longer); else its first subsidiary or brand.
    ``names`` has ticker, name, strength (subsidiary or brand), pos, excludes. Texts without occurrences are gone over once for both
    lexicons, and what was found is written, without the texts."""
    if not set(SIDES) <= set(texts.columns):
        whole = lexicon.marked(texts, ("text_f", "head_f"), (aliases, ("alias", "requires", "excludes")), (names, ("name", "excludes")))
        if whole is not None:
            texts = written(whole.select("article_id", "collector", "is_official", "tickers_hint", *SIDES))
    known = hinted(texts, aliases)
    hits = alias_hits(texts, aliases).filter("reason is null")
    order = F.struct((~F.col("is_primary")).alias("a"), (~F.col("in_headline")).alias("b"), (-F.length("alias")).alias("c"), F.col("alias"))
    best = hits.groupBy("article_id", "ticker").agg(F.min_by(F.struct("alias", F.when(F.col("is_primary"), "primary").otherwise("secondary").alias("strength"), "in_headline"), order).alias("b")).select("article_id", "ticker", "b.*")
    found = known.unionByName(best.join(known, ["article_id", "ticker"], "left_anti"))
    order = F.struct((F.col("strength") != "subsidiary").alias("s"), "pos", "name")
    also = free(texts, names, "name").groupBy("article_id", "ticker").agg(F.min_by(F.struct(F.col("name").alias("alias"), "strength", "in_headline"), order).alias("b"))
    also = also.select("article_id", "ticker", "b.*")
    return found.unionByName(also.join(found, ["article_id", "ticker"], "left_anti"))


def exposures(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(article_id, ticker, exposure_type, term, relationship, weight, role, in_headline, flags): at most
    PER_TYPE terms of a type, longest first (EX1-EX3). ``terms`` has ticker, exposure_type, term, role,
    is_export_market, is_international, is_associate, excludes."""
    found = free(texts, terms, "term")
    order = Window.partitionBy("article_id", "ticker", "exposure_type").orderBy(F.desc(F.length("term")), F.lower("term"))
    found = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= PER_TYPE).drop("n")
    kind, low = F.col("exposure_type"), F.lower("term")
    weight = lookup(WEIGHTS, kind)
    weight = F.when((kind == "GEOGRAPHY") & low.isin(GENERIC_PLACES), 0.2).when((kind == "GEOGRAPHY") & F.col("is_export_market"), 0.8).otherwise(weight)
    weight = weight + F.when((kind == "INDUSTRY") & F.col("is_international"), 0.3).otherwise(0.0)
    weight = weight + F.when((kind == "COMMODITY") & F.coalesce("role", F.lit("input")).isin("input", "output"), 0.5).otherwise(0.0)
    weight = weight + F.when(F.col("in_headline"), 0.5).otherwise(0.0)
    # caps come last, so that no bonus escapes them
    generic = kind.isin("CUSTOMER", "SUPPLIER", "COMPETITOR") & ~text.is_named(F.col("term"))
    single = kind.isin("INDUSTRY", "PRODUCT", "TECHNOLOGY") & (F.size(F.split(F.trim("term"), r"\s+")) == 1)
    weight = F.when(generic, F.least(weight, F.lit(1.0))).when(single, F.least(weight, F.lit(0.9))).otherwise(weight)
    relation = F.when(generic | single, "SECTOR").when((kind == "SUBSIDIARY") & F.col("is_associate"), "INDIRECT_STRONG").otherwise(lookup(BASE, kind))
    return found.withColumns({"weight": F.round(weight, 2), "relationship": relation, "role": F.when(kind == "COMMODITY", F.coalesce("role", F.lit("input")))})


def exposure_summary(found: DataFrame) -> DataFrame:
    """(article_id, ticker, total_weight, strongest, exposures): terms by weight, type and name (EX4)."""
    one = F.struct((-F.col("weight")).alias("minus"), F.col("exposure_type"), F.col("term"), F.col("relationship"), F.col("role"), F.col("in_headline"), F.col("is_export_market"), F.col("is_international"))
    return found.groupBy("article_id", "ticker").agg(F.round(F.sum("weight"), 2).alias("total_weight"), F.max(rank_of(F.col("relationship"))).alias("strongest"), F.array_sort(F.collect_list(one)).alias("exposures"))
