"""The event store: matching, merging, history and questions (ES1-ES10, PR1).

Tables: ``event`` (event_id, title, cluster_key, event_date, event_types, tickers, is_international,
has_official, primary_source, max_impact, scope, year, sequence), ``event_stock`` (event_id, ticker,
relationship, impact_score, direction, confidence), ``event_source`` (event_id, url, source_name,
source_domain, is_official), ``event_history`` (event_id, change, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import text
from newsloom.operators.dedup import ratio_bound, sequence_ratio, similarity_of
from newsloom.operators.graph import written

WINDOW_DAYS, SIMILARITY, CATEGORY_BONUS = 21, 0.55, 0.10
#: What a score hangs on, as JSON.
KIND = "title string, event_types array<string>"
#: Reserved, never filled (PR1).
PRICE_REACTION = T.StructType([T.StructField(n, T.DoubleType()) for n in ("price_at_event", "return_1d", "return_3d", "return_5d", "return_10d", "return_20d", "return_60d", "volume_change", "gap_percentage")] + [T.StructField("provider", T.StringType())])


def least_shared(likeness: float) -> float:
    """The least containment of two titles that can reach a likeness, whatever their sequence ratio (at most 1) and
    Jaccard (at most the containment) are: 0.5 j + 0.3 + 0.2 c or 0.8 c."""
    return max(0.0, min((likeness - 0.3 - 0.0002) / 0.7, (likeness - 0.0002) / 0.8))


def _title_candidates(left: DataFrame, right: DataFrame, shared: float) -> DataFrame:
    """(kind_i, kind_s): titles of one ticker and near days that can share that part of the shorter one's words. Words
    are met rarest first: if the shorter title of n words shares k of them, it shares one of its first n - k + 1."""
    often = right.select("ticker", F.explode("words").alias("word")).groupBy("ticker", "word").agg(F.count("*").alias("often"))
    window = Window.partitionBy("id", "ticker", "bucket").orderBy(F.coalesce("often", F.lit(0)), "word")

    def ranked(df: DataFrame, key: str) -> DataFrame:
        rows = df.select(F.col("kind").alias("id"), "ticker", "bucket", F.size("words").alias("n"), F.explode("words").alias("word")).join(often, ["ticker", "word"], "left")
        first = F.col("n") - F.greatest(F.ceil(F.col("n") * shared), F.lit(1)) + 1
        return rows.withColumn("early", F.row_number().over(window) <= first).select(F.col("id").alias(key), "ticker", "bucket", "word", F.col("n").alias(f"n_{key}"), F.col("early").alias(f"early_{key}"))

    met = ranked(left, "kind_i").join(ranked(right, "kind_s"), ["ticker", "bucket", "word"])
    return met.filter(F.when(F.col("n_kind_i") <= F.col("n_kind_s"), F.col("early_kind_i")).otherwise(F.col("early_kind_s"))).select("kind_i", "kind_s").distinct()


def _title_words() -> Column:
    return F.array_distinct(text.canonical_tokens(text.fold(F.col("title"))))


def _scores(kinds: DataFrame, incoming: DataFrame, stored: DataFrame, ratio, least: float | None) -> DataFrame:
    """(kind_i, kind_s, score) of pairs of kinds, with ``least`` of those that reach it; the sequence ratio runs once for two kinds."""

    def facts(df: DataFrame, n: str) -> DataFrame:
        made = df.select("kind").distinct().select("kind", F.from_json("kind", KIND).alias("k")).select("kind", F.col("k.event_types").alias("types"), "k.title")
        made = made.select("kind", "types", text.fold(F.col("title")).alias("title"), _title_words().alias("words"))
        return made.select(*[F.col(c).alias(f"{c}_{n}") for c in made.columns])

    parts = {
        "jaccard": text.jaccard(F.col("words_i"), F.col("words_s")), "containment": text.containment(F.col("words_i"), F.col("words_s")),
        "bonus": F.when(F.arrays_overlap("types_i", "types_s"), CATEGORY_BONUS).otherwise(0.0),
    }
    both = kinds.join(facts(incoming, "i"), "kind_i").join(facts(stored, "s"), "kind_s").withColumns(parts)
    if least is not None:
        both = both.filter(similarity_of(F.col("jaccard"), F.col("containment"), ratio_bound(F.col("title_i"), F.col("title_s"))) + F.col("bonus") + 0.0002 >= least)
    score = F.round(similarity_of(F.col("jaccard"), F.col("containment"), ratio("title_i", "title_s")) + F.col("bonus"), 4)
    scored = both.select("kind_i", "kind_s", score.alias("score"))
    return written(scored if least is None else scored.filter(F.col("score") >= least))


def find_existing(incoming: DataFrame, stored: DataFrame, days: int = WINDOW_DAYS, similarity: float = SIMILARITY, ratio=sequence_ratio) -> DataFrame:
    """(incoming_id, event_id, score): the stored event that each incoming one continues (ES1). They share a
    ticker and lie within the window; an equal cluster key wins, else the most similar title. Equal keys meet in an
    equi-join in stretches of days, an incoming event in its own and the two beside it; only events that no key matches go on to titles.

    A score hangs on two *kinds*, a title with its types each, and of stored events alike in ticker, day, kind (and key)
    only the one of the smallest id can be chosen: they are one entry. Kinds are scored once, and titles meet by their rarer
    words as the kinds of a ticker and stretch, so that the work grows with what differs, not with the events of a day squared."""
    stretch = F.floor(F.datediff("event_date", F.lit("1970-01-01").cast("date")) / (days + 1))
    kind = F.to_json(F.struct("title", "event_types"))

    def side(df: DataFrame) -> DataFrame:
        return df.select("event_id", "cluster_key", F.col("event_date").alias("day"), F.explode("tickers").alias("ticker"), stretch.alias("bucket"), kind.alias("kind"))

    left = side(incoming).withColumnRenamed("event_id", "incoming_id")
    # a stored event that comes in again is an entry of its own, as it is none for itself
    again = written(stored.select("event_id").join(incoming.select("event_id"), "event_id", "left_semi").distinct())
    named = side(stored).join(again.select("event_id", F.col("event_id").alias("self")), "event_id", "left")
    right = written(named.groupBy("ticker", "bucket", "cluster_key", "kind", "day", "self").agg(F.min("event_id").alias("event_id")))

    def around(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))

    def met(rows: DataFrame, *keys: str) -> DataFrame:
        """(incoming_id, kind_i, kind_s, event_id): the smallest id of each kind among the entries with equal keys within the window."""
        entries = right if "cluster_key" in keys else right.groupBy("ticker", "bucket", "kind", "day", "self").agg(F.min("event_id").alias("event_id"))
        entries = entries.withColumnsRenamed({"kind": "kind_s", "day": "day_s"})
        near = around(rows.withColumnsRenamed({"kind": "kind_i", "day": "day_i"})).join(entries, ["ticker", "bucket", *keys])
        near = near.filter((F.abs(F.datediff("day_i", "day_s")) <= days) & (F.col("self").isNull() | (F.col("self") != F.col("incoming_id"))))
        return near.groupBy("incoming_id", "kind_i", "kind_s").agg(F.min("event_id").alias("event_id"))

    def best(found: DataFrame, scores: DataFrame) -> DataFrame:
        order = F.struct((-F.col("score")).alias("b"), F.col("event_id"))
        return found.join(scores, ["kind_i", "kind_s"]).groupBy("incoming_id").agg(F.min_by(F.struct("event_id", "score"), order).alias("m")).select("incoming_id", "m.event_id", "m.score")

    same = written(met(left.filter("cluster_key <> ''"), "cluster_key"))
    matched = written(best(same, _scores(same.select("kind_i", "kind_s").distinct(), left, right, ratio, None)))
    likeness = similarity - CATEGORY_BONUS
    if likeness > 1:
        return matched
    rest = written(left.join(matched, "incoming_id", "left_anti").drop("cluster_key"))
    kinds_of = lambda df: df.select("ticker", "bucket", "kind").distinct().withColumn("title", F.from_json("kind", KIND)["title"]).withColumn("words", _title_words())
    ours, theirs = kinds_of(around(rest)), kinds_of(right)
    if likeness <= 0.3:
        kinds = ours.select("ticker", "bucket", F.col("kind").alias("kind_i")).join(theirs.select("ticker", "bucket", F.col("kind").alias("kind_s")), ["ticker", "bucket"]).select("kind_i", "kind_s").distinct()
    else:
        kinds = _title_candidates(ours, theirs, least_shared(likeness))
    scores = _scores(kinds, rest, right, ratio, similarity)
    alike = rest.join(scores.select(F.col("kind_i").alias("kind"), "kind_s"), "kind")
    return matched.unionByName(best(met(alike, "kind_s"), scores))


def new_sources(incoming: DataFrame, stored: DataFrame, matches: DataFrame) -> DataFrame:
    """Sources of incoming events whose address the stored event lacks, under the stored id."""
    moved = incoming.withColumnRenamed("event_id", "incoming_id").join(matches.select("incoming_id", "event_id"), "incoming_id").drop("incoming_id")
    return moved.join(stored.select("event_id", "url"), ["event_id", "url"], "left_anti").dropDuplicates(["event_id", "url"])


def merge_stocks(incoming: DataFrame, stored: DataFrame, matches: DataFrame) -> DataFrame:
    """(event_id, ticker, relationship, impact_score, direction, confidence, change, detail) after the merge (ES2,
    ES3): a new company is added, a higher score replaces, another direction replaces whatever its score.
    Several incoming events for one stored event are folded in order of their ids (ES4), row by row of a
    company, in one pass over each (event, company)."""
    moved = incoming.withColumnRenamed("event_id", "incoming_id").join(matches.select("incoming_id", "event_id"), "incoming_id")
    columns = ["relationship", "impact_score", "direction", "confidence"]
    rows = stored.select("event_id", "ticker", F.lit("").alias("seq"), *columns).unionByName(moved.select("event_id", "ticker", F.col("incoming_id").alias("seq"), *columns))
    steps = rows.groupBy("event_id", "ticker").agg(F.array_sort(F.collect_list(F.struct("seq", *columns))).alias("s"))
    start = F.struct(F.get("s", F.lit(0)).alias("now"), F.when(F.get("s", F.lit(0))["seq"] != "", F.array(F.struct(F.lit("stock added").alias("change"), F.concat(F.col("ticker"), F.lit(" ("), F.get("s", F.lit(0))["relationship"], F.lit(")")).alias("detail")))).otherwise(F.array().cast("array<struct<change:string,detail:string>>")).alias("log"))

    def fold(state: Column, new: Column) -> Column:
        old, log = state["now"], state["log"]
        up, turned = new["impact_score"] > old["impact_score"], new["direction"] != old["direction"]
        entry = F.struct(F.when(up, "impact raised").otherwise("direction changed").alias("change"), F.concat(F.col("ticker"), F.lit(" "), F.when(up, old["impact_score"].cast("string")).otherwise(old["direction"]), F.lit(" -> "), F.when(up, new["impact_score"].cast("string")).otherwise(new["direction"])).alias("detail"))
        return F.struct(F.when(up | turned, new).otherwise(old).alias("now"), F.when(up | turned, F.concat(log, F.array(entry))).otherwise(log).alias("log"))

    done = steps.withColumn("d", F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), start, fold))
    return done.select("event_id", "ticker", *[F.col(f"d.now.{c}").alias(c) for c in columns], F.col("d.log").alias("log"))


def merge_events(incoming: DataFrame, stored: DataFrame, matches: DataFrame) -> DataFrame:
    """Stored events with added categories, an official title where one first comes, the earlier day and OR-ed
    flags; incoming events without a match as they are."""
    moved = incoming.join(matches.select(F.col("incoming_id").alias("event_id"), F.col("event_id").alias("target")), "event_id", "left")
    fresh = moved.filter("target is null").drop("target")
    official = F.min_by(F.when(F.col("has_official"), F.struct("title", "primary_source")), F.when(F.col("has_official"), F.col("event_id")))
    adds = moved.filter("target is not null").groupBy(F.col("target").alias("t")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_types"))), lambda x: x["event_types"])).alias("types"), F.flatten(F.collect_list("tickers")).alias("more"),
        F.min("event_date").alias("day"), F.bool_or("is_international").alias("abroad"), F.bool_or("has_official").alias("official"), official.alias("o"), F.max("max_impact").alias("top"),
    )
    both = stored.join(adds, stored["event_id"] == adds["t"], "left")
    turn = F.coalesce("official", F.lit(False)) & ~F.col("has_official")
    none = F.array().cast("array<string>")
    changed = {
        "event_types": F.array_distinct(F.concat("event_types", F.coalesce("types", none))), "tickers": F.array_sort(F.array_union("tickers", F.coalesce("more", none))),
        "event_date": F.least("event_date", "day"), "is_international": F.col("is_international") | F.coalesce("abroad", F.lit(False)),
        "title": F.when(turn, F.col("o.title")).otherwise(F.col("title")), "primary_source": F.when(turn, F.col("o.primary_source")).otherwise(F.col("primary_source")),
        "has_official": F.col("has_official") | F.coalesce("official", F.lit(False)), "max_impact": F.greatest("max_impact", "top"),
    }
    return both.select(*[changed.get(c, F.col(c)).alias(c) for c in stored.columns]).unionByName(fresh.select(*stored.columns))


def query(events: DataFrame, ticker: str | None = None, categories: list[str] | None = None, since: str | None = None, until: str | None = None, min_impact: int = 0, limit: int = 200) -> DataFrame:
    """Stored events that answer a historical question, newest first (ES5)."""
    out = events.filter(F.col("max_impact") >= min_impact)
    if ticker:
        out = out.filter(F.array_contains("tickers", ticker.upper()))
    if categories:
        out = out.filter(F.arrays_overlap("event_types", F.array(*[F.lit(c.upper()) for c in categories])))
    if since:
        out = out.filter(F.col("event_date") >= F.lit(since).cast("date"))
    if until:
        out = out.filter(F.col("event_date") <= F.lit(until).cast("date"))
    return out.orderBy(F.desc_nulls_last("event_date"), F.desc("event_id")).limit(limit)


def stats(events: DataFrame) -> DataFrame:
    """(ticker, events), with the number of all events under ``*`` (ES6)."""
    return events.select(F.explode("tickers").alias("ticker")).groupBy("ticker").agg(F.count("*").alias("events")).unionByName(events.agg(F.count("*").alias("events")).select(F.lit("*").alias("ticker"), "events"))


def metrics(sources: DataFrame, stocks: DataFrame) -> DataFrame:
    """Counts of articles and domains, the top impact and its company for each event (ES7)."""
    by_source = sources.groupBy("event_id").agg(F.count("*").alias("article_count"), F.count_distinct("source_domain").alias("source_count"), F.bool_or("is_official").alias("has_official"))
    by_stock = stocks.groupBy("event_id").agg(F.max("impact_score").alias("max_impact"), F.min_by("ticker", F.struct((-F.col("impact_score")).alias("s"), "ticker")).alias("top_ticker"), F.count_distinct("ticker").alias("n_tickers"))
    return by_source.join(by_stock, "event_id", "left")


def best_stored(events: DataFrame, profiles: DataFrame, top: int = 25) -> DataFrame:
    """The strongest of the ``top`` events that touches a known company (ES8)."""
    first = events.orderBy(F.desc("max_impact"), "event_id").limit(top)
    known = first.select("event_id", F.explode("tickers").alias("ticker")).join(profiles.select("ticker"), "ticker", "left_semi")
    return first.join(known, "event_id", "left_semi").orderBy(F.desc("max_impact"), "event_id").limit(1)


def by_id(events: DataFrame, event_id: str) -> DataFrame:
    """A point lookup; scope and year of the id prune partitions (ES10)."""
    head, year, _ = event_id.removeprefix("EVENT-").rsplit("-", 2)
    return events.filter((F.col("scope") == head) & (F.col("year") == int(year)) & (F.col("event_id") == event_id))


def save(events: DataFrame, path: str) -> None:
    """The event table by year and scope (SK1); a rewrite replaces the partitions it touches."""
    events.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "scope").parquet(path)


def save_day(df: DataFrame, path: str, day_column: str = "run_date") -> None:
    """A day's snapshot (SK2, SK4): only its partition is replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_column).parquet(path)


def index(events: DataFrame) -> DataFrame:
    """The light projection of the store, in order of the ids (SK3)."""
    return events.select("event_id", "event_date", "tickers", "event_types", "cluster_key", "title", "max_impact").orderBy("event_id")


def rebuild_index(files: DataFrame) -> DataFrame:
    """The same projection of event files as ``landing.event_files`` reads them (ES9): companies are the keys of a map."""
    return index(files.withColumns({"tickers": F.array_sort(F.map_keys("stocks")), "max_impact": F.array_max(F.transform(F.map_values("stocks"), lambda s: s["impact_score"]))}))
