"""Readers of landed payloads into one article shape (SC1-SC13). No network: files are landed before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import dates, text

#: The shape that every reader returns.
ARTICLE = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("url", T.StringType()), T.StructField("source_name", T.StringType()), T.StructField("source_domain", T.StringType()),
    T.StructField("source_type", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("published", T.TimestampType()), T.StructField("collector", T.StringType()),
    T.StructField("query", T.StringType()), T.StructField("tickers_hint", T.ArrayType(T.StringType())), T.StructField("is_official", T.BooleanType()), T.StructField("consumer", T.BooleanType()),
    T.StructField("score", T.LongType()), T.StructField("num_comments", T.LongType()),
])
STRING, LONG = T.StringType(), T.LongType()


def article(df: DataFrame, **columns: Column) -> DataFrame:
    """A frame of the article shape; what isn't given is null or empty."""
    blank = {"source_type": F.lit("unknown"), "tickers_hint": F.array().cast("array<string>"), "is_official": F.lit(False), "consumer": F.lit(False), "summary": F.lit("")}
    return df.select(*[columns.get(f.name, blank.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in ARTICLE.fields])


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, STRING) for n in names])


def unreadable(spark: SparkSession, path: str, schema: T.StructType, form: str = "json", **options: str) -> DataFrame:
    """(file, reason, fields) of a reader's records that its schema cannot be read from (RL10): the record's beginning and how many
    fields were read none the less. Readers skip such records; this names them. ``options`` are the reader's own."""
    with_text = T.StructType([*schema.fields, T.StructField("_corrupt_record", STRING)])
    reader = spark.read.format(form).schema(with_text).options(mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", **options)
    read = sum((F.col(f.name).isNotNull().cast("int") for f in schema.fields), F.lit(0))
    rows = reader.load(path).select(F.input_file_name().alias("file"), F.substring(F.trim("_corrupt_record"), 1, 120).alias("reason"), read.alias("fields"))
    return rows.filter(F.col("reason").isNotNull())


FEED_ITEM = T.StructType([
    *_strings("title", "link", "description", "pubDate", "published", "updated").fields, T.StructField("source", _strings("_VALUE", "_url")),
])
INDEX = T.StructType([T.StructField("articles", T.ArrayType(_strings("url", "title", "domain", "seendate", "language", "sourcecountry")))])
ANNOUNCEMENT = ("symbol", "desc", "subject", "attchmntText", "smIndustry", "attchmntFile", "fileName", "an_dt", "exchdisstime")
ANNOUNCEMENTS = T.StructType([*_strings(*ANNOUNCEMENT).fields, T.StructField("data", T.ArrayType(_strings(*ANNOUNCEMENT)))])
TABLE = T.StructType([
    T.StructField("Table", T.ArrayType(_strings("HEADLINE", "NEWSSUB", "SLONGNAME", "SCRIP_CD", "ATTACHMENTNAME", "MORE", "News_submission_dt", "DT_TM"))),
])
POST = T.StructType([
    *_strings("title", "selftext", "permalink", "url", "subreddit", "removed_by_category").fields, T.StructField("score", LONG), T.StructField("num_comments", LONG),
    T.StructField("over_18", T.BooleanType()), T.StructField("created_utc", T.DoubleType()),
])
LISTING = T.StructType([T.StructField("data", T.StructType([T.StructField("children", T.ArrayType(T.StructType([T.StructField("data", POST)])))]))])
VIDEO = T.StructType([T.StructField("id", _strings("videoId")), T.StructField("snippet", _strings("title", "description", "channelTitle", "publishedAt"))])
VIDEOS = T.StructType([T.StructField("items", T.ArrayType(VIDEO))])


def rss(spark: SparkSession, path: str, collector: str = "rss", source_name: str = "", hints: list[str] = []) -> DataFrame:
    """Feed items (SC1): without title or link they go; a nested source names the publisher."""
    items = spark.read.format("xml").option("rowTag", "item").schema(FEED_ITEM).load(path)
    when = dates.parse_date(F.coalesce("published", "updated", "pubDate"))
    good = items.filter((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("link", F.lit(""))) != ""))
    return article(good, title=F.col("title"), url=F.trim("link"), source_name=F.coalesce("source._VALUE", F.lit(source_name)), summary=F.coalesce("description", F.lit("")), published=when, collector=F.lit(collector), tickers_hint=F.array(*[F.lit(h) for h in hints]) if hints else F.array().cast("array<string>"))


def atom(spark: SparkSession, path: str, collector: str = "rss", source_name: str = "") -> DataFrame:
    schema = T.StructType([T.StructField(n, STRING) for n in ("title", "summary", "published", "updated")] + [T.StructField("link", T.StructType([T.StructField("_href", STRING)]))])
    items = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path).filter("title is not null and link._href is not null")
    return article(items, title=F.col("title"), url=F.col("link._href"), source_name=F.lit(source_name), summary=F.coalesce("summary", F.lit("")), published=dates.parse_date(F.coalesce("published", "updated")), collector=F.lit(collector))


def search_feed(items: DataFrame, searches: DataFrame, most: int) -> DataFrame:
    """Feed items of searches with what the search was, at most so many a search; no hint, as a search only
    asked (SC2). ``items`` has query and the article's columns; ``searches`` query, kind, ticker, term."""
    from newsloom.operators.dedup import rank_in

    cut = rank_in(items, ["query"], [F.desc_nulls_last("published"), "url"]).filter(F.col("rank") <= most).drop("rank")
    return cut.join(searches.select("query", F.col("kind").alias("query_kind"), F.col("ticker").alias("query_ticker"), F.col("term").alias("query_term")), "query", "left").withColumn("tickers_hint", F.array().cast("array<string>"))


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """An index's JSON (SC3)."""
    rows = spark.read.schema(INDEX).option("multiLine", True).json(path).select(F.explode("articles").alias("a")).filter("a.title is not null and a.url is not null")
    return article(rows, title=F.col("a.title"), url=F.col("a.url"), source_domain=F.col("a.domain"), source_name=F.col("a.domain"), published=dates.parse_date(F.col("a.seendate")), collector=F.lit("gdelt"))


def exchange_announcements(spark: SparkSession, path: str, profiles: DataFrame) -> DataFrame:
    """One exchange's announcements, a list or under ``data``, for known symbols (SC4). ``profiles`` has ticker,
    company; files are named by symbol."""
    raw = spark.read.schema(ANNOUNCEMENTS).option("multiLine", True).json(path)
    one = F.struct(*[F.col(f) for f in ANNOUNCEMENT])
    rows = raw.select(F.explode(F.when(F.col("data").isNotNull(), F.col("data")).otherwise(F.array(one))).alias("a")).select("a.*")
    known = rows.join(profiles.select(F.col("ticker").alias("symbol"), "company"), "symbol").withColumn("what", F.coalesce("desc", "subject")).filter("what is not null")
    return article(known, title=F.concat_ws(": ", "company", "what"), url=F.coalesce("attchmntFile", "fileName"), source_type=F.lit("exchange_filing"), summary=F.coalesce("attchmntText", F.lit("")), published=dates.parse_date(F.coalesce("an_dt", "exchdisstime")), collector=F.lit("nse"), tickers_hint=F.array("symbol"), is_official=F.lit(True))


def second_exchange(spark: SparkSession, path: str, codes: DataFrame, base_url: str) -> DataFrame:
    """The other exchange's payloads (SC5): one whose company's name doesn't fit its code goes whole.
    ``codes`` has code, ticker, company."""
    raw = spark.read.schema(TABLE).option("multiLine", True).json(path)
    rows = raw.withColumn("file", F.input_file_name()).select("file", F.explode("Table").alias("a")).select("file", "a.*").join(codes, F.col("SCRIP_CD") == F.col("code"))
    words = lambda c: F.slice(F.filter(F.split(text.fold(c), r"[^a-z0-9]+"), lambda w: w != ""), 1, 2)
    fits = F.regexp_like(text.fold(F.col("SLONGNAME")), text.phrase_pattern(F.col("company"))) | (words(F.col("SLONGNAME")) == words(F.col("company")))
    good = rows.groupBy("file").agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("fits")).filter("fits")
    kept = rows.join(good, "file", "left_semi").withColumn("what", F.coalesce("HEADLINE", "NEWSSUB")).filter("what is not null")
    return article(kept, title=F.concat_ws(": ", "company", "what"), url=F.concat(F.lit(base_url), "ATTACHMENTNAME"), source_type=F.lit("exchange_filing"), summary=F.coalesce("MORE", F.lit("")), published=dates.parse_date(F.coalesce("News_submission_dt", "DT_TM")), collector=F.lit("bse"), tickers_hint=F.array("ticker"), is_official=F.lit(True))


def regulator_items(items: DataFrame, interested: DataFrame) -> DataFrame:
    """Items of regulators with all tickers that watch the regulator (SC6). ``items`` has regulator and the
    article's columns; ``interested`` (alias, ticker) of the profiles' regulation terms."""
    known = items.select("regulator").distinct().join(interested, F.lower("regulator") == F.lower("alias")).groupBy("regulator").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    out = items.join(known, "regulator", "left")
    return out.withColumns({"tickers_hint": F.coalesce("tickers", F.array().cast("array<string>")), "source_type": F.lit("regulator"), "is_official": F.lit(True)}).drop("tickers")


def wanted_feeds(registry: DataFrame, tickers: list[str]) -> DataFrame:
    """Feeds that serve one of some tickers; a feed without tickers serves all (SC9)."""
    return registry.filter((F.size("tickers") == 0) | F.arrays_overlap("tickers", F.array(*[F.lit(t) for t in tickers])))


def forum(spark: SparkSession, path: str, base_url: str, least_score: int = 0) -> DataFrame:
    """Forum listings (SC10): adult, removed and low posts go; a time that isn't after 1970 is unknown."""
    rows = spark.read.schema(LISTING).option("multiLine", True).json(path).select(F.explode("data.children").alias("c")).select("c.data.*")
    good = rows.filter((F.coalesce("title", F.lit("")) != "") & ~F.coalesce("over_18", F.lit(False)) & F.col("removed_by_category").isNull() & (F.coalesce("score", F.lit(0)) >= least_score))
    when = F.when(F.col("created_utc") > 0, F.timestamp_seconds("created_utc"))
    return article(good, title=F.col("title"), url=F.coalesce(F.concat(F.lit(base_url), "permalink"), "url"), source_name=F.concat(F.lit("r/"), "subreddit"), source_type=F.lit("social"), summary=F.coalesce("selftext", F.lit("")), published=when, collector=F.lit("forum"), consumer=F.lit(True), score=F.col("score"), num_comments=F.col("num_comments"))


def videos(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """Video searches (SC11)."""
    rows = spark.read.schema(VIDEOS).option("multiLine", True).json(path).select(F.explode("items").alias("i")).filter("i.id.videoId is not null and i.snippet.title is not null")
    return article(rows, title=text.clean_text(F.col("i.snippet.title")), url=F.concat(F.lit(base_url), "i.id.videoId"), source_name=F.col("i.snippet.channelTitle"), source_type=F.lit("social"), summary=text.clean_text(F.col("i.snippet.description")), published=dates.parse_date(F.col("i.snippet.publishedAt")), collector=F.lit("video"), consumer=F.lit(True))


#: An event file; companies are a map, so that no company becomes a column.
EVENT = "event_id string, title string, summary string, event_date date, event_types array<string>, stocks map<string, struct<relationship:string,impact_score:int,direction:string,confidence:double>>, sources array<struct<title:string,url:string,source_name:string,source_domain:string,source_type:string,is_official:boolean,quality:int>>, primary_source string, cluster_key string, is_international boolean, _corrupt_record string"


def event_files(spark: SparkSession, path: str) -> DataFrame:
    """Event files, one each, in folders by year and scope; files that aren't JSON are skipped (SC12)."""
    rows = spark.read.schema(EVENT).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    return rows.filter("_corrupt_record is null and event_id is not null").drop("_corrupt_record")


def given(df: DataFrame) -> DataFrame:
    """Any frame with some of the article's columns, as an article frame (SC13)."""
    return article(df, **{c: F.col(c) for c in df.columns if c in ARTICLE.names})
