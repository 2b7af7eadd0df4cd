"""De-duplication and incremental state (DD1-DD9)."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import text
from newsloom.operators.graph import components, written
from newsloom.operators.normalize import quality_of

SIMILARITY, WINDOW_DAYS = 0.88, 5


def best_first() -> Column:
    """Smallest for the best copy: official, then quality, dated, longer summary, older, id (DD1)."""
    return F.struct(
        (~F.col("is_official")).alias("a"), (-quality_of(F.col("source_type"))).alias("b"), F.col("published").isNull().alias("c"),
        (-F.length(F.coalesce("summary", F.lit("")))).alias("d"), F.coalesce("published", F.lit("1970-01-01").cast("timestamp")).alias("e"), F.col("article_id").alias("f"),
    )


def url_key() -> Column:
    return F.lower(F.coalesce(F.col("url"), F.lit("")))


def title_key() -> Column:
    key = text.normalize_title(F.col("title"))
    return F.when(key != "", F.concat_ws("|", key, F.lower(F.coalesce(F.col("source_domain"), F.lit(""))))).otherwise("")


def collapse(articles: DataFrame, key: Column) -> DataFrame:
    """The best row for each key; rows with a blank key stay. An aggregate, so a hot key is combined
    where its rows are read (DD2 with url_key, DD3 with title_key)."""
    keyed = articles.withColumn("_key", key)
    rows = F.struct(*[F.col(c) for c in articles.columns])
    best = keyed.filter("_key <> ''").groupBy("_key").agg(F.min_by(rows, best_first()).alias("r")).select("r.*")
    return best.unionByName(keyed.filter("_key = ''").drop("_key"))


def lineage(articles: DataFrame, key: Column) -> DataFrame:
    """(winner, losers, n): the addresses that each kept article stands for (DD5)."""
    keyed = articles.withColumn("_key", key).filter("_key <> ''")
    best = keyed.groupBy("_key").agg(F.min_by("article_id", best_first()).alias("winner"))
    lost = keyed.join(best, "_key").filter("article_id <> winner")
    return lost.groupBy("winner").agg(F.array_sort(F.collect_list("url")).alias("losers"), F.count("*").alias("n"))


def jaccard_bound(similarity: float) -> float:
    """The least Jaccard of two titles that can reach a similarity, whatever their sequence ratio
    (at most 1) and containment (at most 1) are; 0 where the containment rule alone can reach it."""
    if similarity <= 0.8:
        return 0.0
    return max(0.0, (similarity - 0.0001 - 0.3 - 0.2) / 0.5)


def near_candidates(keys: DataFrame, days: int, bound: float) -> DataFrame:
    """(a, b): articles of one domain that share a key word and lie in the same or the next stretch of days, an undated one with all of
    its domain. ``keys`` has article_id, domain, word, ``day`` (microseconds) and ``n``, the number of the title's words, which may
    differ as far as a Jaccard of ``bound`` lets them. A stretch is part of the join's key, so that a word's history is many keys."""
    rows = keys.withColumn("own", F.floor(F.col("day") / (max(days, 1) * 86_400_000_000)))
    left = rows.filter("own is not null").withColumn("bucket", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    right = rows.select("domain", "word", F.col("own").alias("bucket"), F.col("article_id").alias("other"), F.col("n").alias("m"))
    near = left.join(right, ["domain", "word", "bucket"]).filter((F.col("own") < F.col("bucket")) | (F.col("article_id") < F.col("other")))
    undated = rows.filter("own is null").join(right.drop("bucket"), ["domain", "word"])
    met = near.select("article_id", "other", "n", "m").unionByName(undated.select("article_id", "other", "n", "m"))
    alike = F.least("n", "m") >= bound * F.greatest("n", "m") - 1e-9
    return met.filter(alike & (F.col("article_id") != F.col("other"))).select(F.least("article_id", "other").alias("a"), F.greatest("article_id", "other").alias("b")).distinct()


#: Rarest common words that two titles meet by, if their likeness leaves them as many; articles of a tile.
TOGETHER, TILE = 3, 1000


def _combinations(words: Column, k: int, first: Column | None = None, chosen: tuple = ()) -> Column:
    """A hash for each combination of k of an array's values, in its order; the array has k at least."""
    places = F.sequence(F.lit(0) if first is None else first, F.size(words) - k)
    if k == 1:
        return F.transform(places, lambda i: F.xxhash64(*chosen, F.get(words, i)))
    return F.flatten(F.transform(places, lambda i: _combinations(words, k - 1, i + 1, (*chosen, F.get(words, i)))))


def _titled(articles: DataFrame, days: int, entry: str, *more: Column) -> DataFrame:
    """(article_id, domain, day, title, words, entry) of articles that can be alike to another: those of a domain that have the same
    ``entry`` (title or words) and lie in one stretch of days are one entry, named by 128 bits of its SHA-256."""
    title = text.fold(F.col("title"))
    rows = articles.select("article_id", F.lower("source_domain").alias("domain"), F.unix_micros("published").alias("day"), title.alias("title"), *more)
    rows = rows.withColumn("words", F.array_sort(F.array_distinct(text.canonical_tokens(F.col("title"))))).filter((F.size("words") > 0) & F.col("domain").isNotNull())
    own = F.coalesce(F.floor(F.col("day") / (max(days, 1) * 86_400_000_000)).cast("string"), F.lit(""))
    return rows.withColumn("entry", F.substring(F.sha2(F.to_json(F.struct("domain", own.alias("own"), entry)), 256), 1, 32))


def near_entries(entries: DataFrame, days: int, bound: float) -> DataFrame:
    """(a, b, jaccard, containment) of entries (entry, domain, day, words) of one domain in the same or the next stretch of days with a Jaccard of ``bound``
    at least. Of two sets with j = ``bound``, the k rarest common words are among the first n - ceil(j n) + k words of each, rarest first: entries
    meet by k words together, so that words that are frequent on their own bring few together. Sets too small to have an unequal partner meet by all their words."""
    least = math.ceil(bound / (1 - bound) - 1e-9) if bound < 1 else 1 << 30  # words of the smallest set that an unequal one can be alike to
    k = min(TOGETHER, math.ceil(bound * least - 1e-9))
    word = entries.select("entry", "domain", "day", F.explode("words").alias("word"))
    often = word.groupBy("domain", "word").agg(F.count("*").alias("n"))
    ranked = word.join(often, ["domain", "word"]).groupBy("entry", "domain", "day").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    n = F.size("w")
    ranked = ranked.select("entry", "domain", "day", n.alias("n"), F.transform(F.slice("w", 1, F.least(n, n - F.ceil(n * bound - 1e-9) + k).cast("int")), lambda x: x["word"]).alias("first"), F.transform("w", lambda x: x["word"]).alias("every"))
    met_by = F.when(F.col("n") >= least, _combinations(F.col("first"), k)).otherwise(F.array(F.xxhash64("every")))
    keys = ranked.select(F.col("entry").alias("article_id"), "domain", "day", "n", F.explode(met_by).alias("word"))
    side = lambda x: entries.select(F.col("entry").alias(x), F.col("words").alias(f"words_{x}"))
    pairs = near_candidates(keys, days, bound).join(side("a"), "a").join(side("b"), "b")
    j, c = text.jaccard(F.col("words_a"), F.col("words_b")), text.containment(F.col("words_a"), F.col("words_b"))
    return pairs.select("a", "b", j.alias("jaccard"), c.alias("containment")).filter(F.col("jaccard") >= bound)


def near_pairs(articles: DataFrame, similarity: float = SIMILARITY, days: int = WINDOW_DAYS) -> DataFrame:
    """(a, b, jaccard, containment): articles of one publisher whose titles share so many words that they
    may be that similar, and which were published at most so many days apart, to the second, or at unknown times. Equal sets of words are
    met and compared once in a stretch of days; their articles are paired at the end, tile by tile, so that no task holds a large group."""
    bound = jaccard_bound(similarity)
    if bound <= 0:
        raise ValueError("at this similarity words cannot narrow the candidates")
    rows = written(_titled(articles, days, "words"))
    entries = written(rows.groupBy("entry").agg(F.first("domain").alias("domain"), F.first("words").alias("words"), F.min("day").alias("day"), F.count("*").alias("n")))
    one = F.lit(1.0)
    near = near_entries(entries, days, bound).unionByName(entries.filter("n > 1").select(F.col("entry").alias("a"), F.col("entry").alias("b"), one.alias("jaccard"), one.alias("containment")))
    dealt = rows.select("entry", "article_id", "day").join(entries.select("entry", "n"), "entry")
    tiles = dealt.groupBy("entry", F.pmod(F.xxhash64("article_id"), F.ceil(F.col("n") / TILE)).alias("tile")).agg(F.collect_list(F.struct("article_id", "day")).alias("held"))
    side = lambda x: tiles.select(F.col("entry").alias(x), F.col("tile").alias(f"tile_{x}"), F.col("held").alias(f"held_{x}"))
    pairs = near.join(side("a"), "a").join(side("b"), "b").filter("a <> b or tile_a <= tile_b").repartition("a", "b", "tile_a", "tile_b")
    same = (F.col("a") == F.col("b")) & (F.col("tile_a") == F.col("tile_b"))
    pairs = pairs.select(same.alias("same"), "jaccard", "containment", F.explode("held_a").alias("x"), "held_b").select("same", "jaccard", "containment", "x", F.explode("held_b").alias("y"))
    near = F.col("x.day").isNull() | F.col("y.day").isNull() | (F.abs(F.col("x.day") - F.col("y.day")) <= days * 86_400_000_000)
    return pairs.filter(near & (~F.col("same") | (F.col("x.article_id") < F.col("y.article_id")))).select(F.least("x.article_id", "y.article_id").alias("a"), F.greatest("x.article_id", "y.article_id").alias("b"), "jaccard", "containment")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that the sequence ratio of two texts can be, by their lengths."""
    return F.coalesce(2.0 * F.least(F.length(a), F.length(b)) / F.nullif(F.length(a) + F.length(b), F.lit(0)), F.lit(1.0))


def similarity_of(jaccard: Column, contained: Column, ratio: Column) -> Column:
    """Title similarity of its three parts (TX8)."""
    return F.round(F.greatest(0.5 * jaccard + 0.3 * ratio + 0.2 * contained, 0.8 * contained), 4)


def _losers(days: int):
    """The articles of whole components, which come one after another in order, that don't survive: each meets the last kept one it is
    alike to, and the better of the two holds the place. A component's entries come first, with those they are alike to and whether
    they are where the own article's id is the smaller or the larger one. Kept in memory are one component's entries and survivors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, around, places, last = None, {}, {}, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["component"] != component:
                    component, around, places, last = row["component"], {}, {}, 0
                entry, article, day = row["entry"], row["article_id"], row["day"]
                if article is None:
                    around[entry] = [(entry, True, True), *[(x["other"], x["smaller"], x["larger"]) for x in row["around"] or ()]]
                    continue
                merit, met = tuple(row["merit"].values()), None
                for other, smaller, larger in around[entry]:
                    for place in places.get(other, ()):
                        near = day is None or place[3] is None or abs(day - place[3]) <= days * 86_400_000_000
                        if near and (smaller if article < place[1] else larger) and (met is None or place[0] > met[0]):
                            met, where = place, other
                if met is None:
                    places.setdefault(entry, []).append((last, article, merit, day))
                    last += 1
                elif merit > met[2]:
                    places[where].remove(met)
                    places.setdefault(entry, []).append((met[0], article, merit, day))
                    out.append(met[1])
                else:
                    out.append(article)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["article_id"])

    return run


def near_duplicates(articles: DataFrame, similarity: float = SIMILARITY, days: int = WINDOW_DAYS) -> DataFrame:
    """The articles without near-duplicates of one publisher (DD4): official, trusted, undated and older ones come first, and
    one that is alike to a survivor takes its place if it is better, else goes. In a chain A-B-C, B goes and A and C stay.
    Equal titles of a publisher in one stretch of days are one entry: titles are compared once, and articles are never paired.
    The order runs inside connected components of entries, which changes nothing, as an article only ever meets one it is alike to;
    the sequence ratio is computed, both ways, for titles that words and lengths don't rule out. Ids are taken to be unique."""
    bound = jaccard_bound(similarity)
    if bound <= 0:
        raise ValueError("at this similarity words cannot narrow the candidates")
    quality = quality_of(F.col("source_type"))
    merit = F.struct(F.col("is_official").alias("official"), quality.alias("quality"), F.col("published").isNotNull().alias("dated"), F.length(F.coalesce("summary", F.lit(""))).alias("length"))
    order = [merit.alias("merit"), (~F.col("is_official")).alias("o1"), (-quality).alias("o2"), F.coalesce(F.unix_micros("published"), F.lit(0)).alias("o3")]
    rows = written(_titled(articles, days, "title", *order))
    entries = written(rows.groupBy("entry").agg(F.first("domain").alias("domain"), F.first("title").alias("title"), F.first("words").alias("words"), F.min("day").alias("day"), F.count("*").alias("n")))
    title = lambda x: entries.select(F.col("entry").alias(x), F.col("title").alias(f"t_{x}"))
    j, c = F.col("jaccard"), F.col("containment")
    able = near_entries(entries, days, bound).join(title("a"), "a").join(title("b"), "b").filter(similarity_of(j, c, ratio_bound(F.col("t_a"), F.col("t_b"))) >= similarity)
    scored = able.select("a", "b", (similarity_of(j, c, sequence_ratio("t_a", "t_b")) >= similarity).alias("there"), (similarity_of(j, c, sequence_ratio("t_b", "t_a")) >= similarity).alias("back"))
    alike = written(scored.filter("there or back"))
    groups = components(alike.select("a", "b")).withColumnRenamed("node", "entry")
    both = alike.select(F.col("a").alias("entry"), F.struct(F.col("b").alias("other"), F.col("there").alias("smaller"), F.col("back").alias("larger")).alias("x"))
    both = both.unionByName(alike.select(F.col("b").alias("entry"), F.struct(F.col("a").alias("other"), F.col("back").alias("smaller"), F.col("there").alias("larger")).alias("x")))
    around = both.groupBy("entry").agg(F.collect_list("x").alias("around"))
    held = written(entries.select("entry", "n").join(groups, "entry", "left").filter("component is not null or n > 1").select("entry", F.coalesce("component", "entry").alias("component")).join(around, "entry", "left"))
    ordered = rows.select("entry", "article_id", "day", "merit", "o1", "o2", "o3").join(held.drop("around"), "entry")
    dealt = held.unionByName(ordered, allowMissingColumns=True).repartition("component").sortWithinPartitions("component", F.col("article_id").isNotNull(), "o1", "o2", "o3", "article_id")
    lost = dealt.select("component", "entry", "article_id", "day", "merit", "around").mapInArrow(_losers(days), "article_id string")
    return articles.join(written(lost), "article_id", "left_anti").select(*articles.columns)


def deduplicate(articles: DataFrame) -> DataFrame:
    """The passes in order, cheapest first."""
    return near_duplicates(collapse(collapse(articles, url_key()), title_key()))


def split_seen(articles: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fresh, seen before) by article_id (DD6)."""
    return articles.join(seen, "article_id", "left_anti"), articles.join(seen, "article_id", "left_semi")


def mark_seen(seen: DataFrame, articles: DataFrame, day: Column) -> DataFrame:
    """(article_id, first_seen) with the new ids; the earlier day stays (DD7)."""
    new = articles.select("article_id", day.alias("first_seen"))
    return seen.select("article_id", "first_seen").unionByName(new).groupBy("article_id").agg(F.min("first_seen").alias("first_seen"))


def prune_seen(seen: DataFrame, today: Column, days: int = 45) -> DataFrame:
    """Undated ids stay (DD8)."""
    return seen.filter(F.col("first_seen").isNull() | (F.col("first_seen") >= F.date_sub(today, days)))


def merge_daily(runs: DataFrame) -> DataFrame:
    """Of each event the row of its last run (DD9); ``runs`` has event_id, run_seq and the event's columns."""
    rows = F.struct(*[F.col(c) for c in runs.columns])
    return runs.groupBy("event_id").agg(F.max_by(rows, "run_seq").alias("r")).select("r.*")


def rank_in(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
