"""Consumer signals by company and day (CS1-CS6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text

# Words counted for and against, by substring.
POSITIVE = ["love", "loved", "amazing", "excellent", "great", "good", "works", "working", "recommend", "recommended", "happy", "impressed", "worth", "effective", "improved", "improvement", "best", "favourite", "favorite", "repurchase", "value for money", "genuine", "fast delivery"]
NEGATIVE = ["hate", "hated", "terrible", "awful", "bad", "worst", "useless", "disappointed", "disappointing", "waste", "waste of money", "fake", "counterfeit", "expired", "damaged", "broke", "broken", "refund", "return", "returned", "scam", "avoid", "irritation", "rash", "allergic", "burning", "hair fall", "hairfall", "no difference", "stopped working", "leaked", "leaking", "delayed", "never arrived", "poor quality"]
EXAMPLES = 3


def label(folded: Column, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> Column:
    """positive, negative or neutral: which words are more (CS1)."""
    sign = text.polarity(folded, positive, negative)
    return F.when(sign > 0, "positive").when(sign < 0, "negative").otherwise("neutral")


def mentions(posts: DataFrame, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> DataFrame:
    """A row for each post and company it is about. ``posts`` has article_id, text, tickers_hint, query_ticker,
    query_term, score, num_comments, title, day."""
    none = F.array().cast("array<string>")
    about = F.when(F.size(F.coalesce("tickers_hint", none)) > 0, F.col("tickers_hint")).otherwise(F.array(F.coalesce("query_ticker", F.lit(""))))
    engagement = F.coalesce("score", F.lit(0)) + F.coalesce("num_comments", F.lit(0))
    rows = posts.select("day", "article_id", "title", F.col("query_term").alias("term"), engagement.alias("engagement"), label(text.fold(F.col("text")), positive, negative).alias("label"), F.explode(F.array_distinct(about)).alias("ticker"))
    return rows.filter("ticker <> ''")


def aggregate(rows: DataFrame) -> DataFrame:
    """Each company's counts of a day, net and leaning (CS2, CS4)."""
    count = lambda kind: F.sum((F.col("label") == kind).cast("int")).cast("long").alias(kind)
    out = rows.groupBy("day", "ticker").agg(F.count("*").alias("mentions"), count("positive"), count("negative"), count("neutral"), F.sum("engagement").cast("long").alias("engagement"))
    return out.withColumn("net", F.col("positive") - F.col("negative")).withColumn("leaning", leaning(F.col("mentions"), F.col("net")))


def leaning(mentions_: Column, net: Column) -> Column:
    bar = F.greatest(F.lit(2), F.floor(mentions_ / 5))
    return F.when(mentions_ < 3, "too few to read").when(net >= bar, "mostly positive").when(net <= -bar, "mostly negative").otherwise("mixed")


def terms(rows: DataFrame) -> DataFrame:
    """(day, ticker, terms): how often each search term found a post."""
    counted = rows.filter("term <> ''").groupBy("day", "ticker", "term").agg(F.count("*").alias("n"))
    return counted.groupBy("day", "ticker").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "n")))).alias("terms"))


def examples(rows: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """The first posts of each company and day (CS3); top rows by an aggregate of bounded size would do the
    same, but the rank is cut before rows leave their task."""
    from newsloom.operators.dedup import rank_in

    return rank_in(rows, ["day", "ticker"], ["article_id"]).filter(F.col("rank") <= most)


def with_previous(signals: DataFrame) -> DataFrame:
    """Each day's signals with those of the latest earlier day on file for any company, and what is notable
    about the change (CS5, CS6). The days are few: one row each."""
    from pyspark.sql import Window

    days = signals.select("day").distinct().withColumn("before", F.lag("day").over(Window.orderBy("day")))
    was = signals.select(F.col("day").alias("before"), "ticker", F.col("mentions").alias("previous_mentions"), F.col("net").alias("previous_net"))
    both = signals.join(days, "day").join(was, ["before", "ticker"], "left").fillna(0, ["previous_mentions", "previous_net"])
    both = both.withColumns({"mention_change": F.col("mentions") - F.col("previous_mentions"), "net_change": F.col("net") - F.col("previous_net")})
    grown = (F.col("previous_mentions") >= 3) & (F.col("mention_change") >= F.greatest(F.lit(3), F.col("previous_mentions")))
    return both.withColumn("notable", (F.col("mentions") >= 3) & (grown | (F.col("net_change") <= -3)))
