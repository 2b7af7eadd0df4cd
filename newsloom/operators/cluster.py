"""From linked articles to events (CL1-CL9).

Candidate pairs come from joins on ticker, day bucket and a shared title word. Articles that are alike in all that
pairs are judged by are one entry there, so that copies of a story are never paired with each other. The greedy
single-link order runs inside stretches of days of the connected components of the pairs that pass, in rounds that hand
decisions across; this gives the same clusters as running it over everything, since an article only ever joins one it passes with."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators.dedup import ratio_bound, sequence_ratio, similarity_of
from newsloom.operators.graph import components, in_order, numbered, written
from newsloom.operators.normalize import quality_of

THRESHOLD, WINDOW_DAYS, PROCEEDING_DAYS = 0.62, 3, 30
# What two articles can gain beyond their titles' likeness, and the most in all.
CATEGORY_BONUS, DAY_BONUS, OFFICIAL_BONUS, DIRECT_BONUS, MOST_BONUS = 0.12, 0.08, 0.08, 0.06, 0.30
# How far clustering trusts each type of source.
RANKS = {"exchange_filing": 10, "regulator": 10, "company_ir": 9, "wire": 8, "financial_press": 7, "newspaper": 6, "trade_publication": 5, "unknown": 3, "blog": 2, "social": 1}


def prepared(articles: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each linked article: tickers, direct tickers, day, title words, deadlines. ``articles``
    has article_id, title, summary, published, is_official, source_type, categories, legal_notice."""
    held = links.groupBy("article_id").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"), F.array_sort(F.collect_set(F.when(F.col("relationship") == "DIRECT", F.col("ticker")))).alias("direct"))
    title = text.fold(F.col("title"))
    return articles.join(held, "article_id").withColumns({
        "title_f": title, "day": F.to_date("published"), "words": F.array_distinct(text.canonical_tokens(title)),
        "deadlines": text.stated_deadlines(text.fold(F.concat_ws(" ", "title", "summary"))),
    })


PAIR_COLUMNS = ["article_id", "tickers", "direct", "day", "words", "title_f", "deadlines", "categories", "is_official", "legal_notice"]


def _candidates(rows: DataFrame, days: int, threshold: float | None = None) -> DataFrame:
    """Pairs of ids that share a ticker and lie in the same or the next stretch of days. With a ``threshold``, those that share a title word,
    lie within the days, and can reach it by the number of words that they share (at most one for each time they meet), whatever
    else is gained; pairs are left out here, before anything else of the articles is joined to them."""
    stretch = F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / (days + 1))
    base = rows.select("article_id", F.explode("tickers").alias("ticker"), stretch.alias("bucket"), F.lit("").alias("word"), "day", F.size("words").alias("n"), "is_official")
    if threshold is not None:
        base = rows.select("article_id", F.explode("words").alias("word"), "tickers", stretch.alias("bucket"), "day", F.size("words").alias("n"), "is_official").withColumn("ticker", F.explode("tickers")).drop("tickers")
    left = base.select(F.col("article_id").alias("a"), "ticker", "word", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"), F.col("bucket").alias("own"), "day", "n", "is_official")
    right = base.select(F.col("article_id").alias("b"), "ticker", "word", "bucket", F.col("day").alias("day_b"), F.col("n").alias("m"), F.col("is_official").alias("official_b"))
    met = left.join(right, ["ticker", "word", "bucket"]).filter(((F.col("own") < F.col("bucket")) | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")))
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    if threshold is None:
        return met.select(*pair).distinct()
    known = [F.least("n", "m").alias("n"), F.greatest("n", "m").alias("m"), (F.col("day") == F.col("day_b")).alias("same_day"), (F.col("is_official") | F.col("official_b")).alias("official")]
    counted = met.filter(F.abs(F.datediff("day", "day_b")) <= days).groupBy(*pair, *known).agg(F.count("*").alias("times"))
    common = F.least("times", "n")
    gain = F.when(F.col("same_day"), DAY_BONUS).otherwise(0.0) + F.when(F.col("official"), OFFICIAL_BONUS).otherwise(0.0) + CATEGORY_BONUS + DIRECT_BONUS
    most = similarity_of(common / (F.col("n") + F.col("m") - common), common / F.col("n"), F.lit(1.0)) + F.least(gain, F.lit(MOST_BONUS))
    return counted.filter(most + 0.0002 >= threshold).select("a", "b")


def scored_pairs(rows: DataFrame, ratio=sequence_ratio, threshold: float = THRESHOLD, days: int = WINDOW_DAYS, proceeding_days: int = PROCEEDING_DAYS) -> DataFrame:
    """(a, b, score, passes) of pairs through the gate (CL1). Pairs without a shared title word cannot reach
    the threshold unless both are notices about one company, which have a path of their own. Pairs whose words,
    title lengths and bonus already rule the threshold out are not returned."""
    most_without_words = 0.3 + MOST_BONUS
    pairs = _candidates(rows, days, threshold if threshold > most_without_words + 0.0001 else None)
    notices = rows.filter("legal_notice and size(direct) > 0")
    pairs = pairs.unionByName(_candidates(notices, proceeding_days)).distinct()
    return _scored(pairs, rows, ratio, threshold, days, proceeding_days)


def _scored(pairs: DataFrame, rows: DataFrame, ratio, threshold: float, days: int, proceeding_days: int) -> DataFrame:
    side = lambda n: rows.select(*[F.col(c).alias(f"{c}_{n}") for c in PAIR_COLUMNS])
    both = pairs.join(side("a"), F.col("a") == F.col("article_id_a")).join(side("b"), F.col("b") == F.col("article_id_b"))
    shared_direct = F.arrays_overlap("direct_a", "direct_b")
    notice = F.col("legal_notice_a") & F.col("legal_notice_b") & (F.size("direct_a") > 0) & shared_direct
    stated = (F.size("deadlines_a") > 0) & (F.size("deadlines_b") > 0)
    conflict = notice & stated & ~F.arrays_overlap("deadlines_a", "deadlines_b")
    proceeding = notice & ~conflict
    apart = F.abs(F.datediff("day_a", "day_b"))
    gate = ~conflict & (apart <= F.when(proceeding, proceeding_days).otherwise(days)) & ((F.size("direct_a") == 0) | (F.size("direct_b") == 0) | shared_direct)
    same_kind = F.size(F.filter(F.array_intersect("categories_a", "categories_b"), lambda c: c != "OTHER")) > 0
    gain = lambda when, points: F.when(when, points).otherwise(0.0)
    bonus = gain(same_kind, CATEGORY_BONUS) + gain(F.col("day_a") == F.col("day_b"), DAY_BONUS) + gain(F.col("is_official_a") | F.col("is_official_b"), OFFICIAL_BONUS) + gain((F.size("direct_a") > 0) & shared_direct, DIRECT_BONUS)
    parts = {"jaccard": text.jaccard(F.col("words_a"), F.col("words_b")), "containment": text.containment(F.col("words_a"), F.col("words_b")), "bonus": F.least(bonus, F.lit(MOST_BONUS)), "proceeding": proceeding}
    able = similarity_of(F.col("jaccard"), F.col("containment"), ratio_bound(F.col("title_f_a"), F.col("title_f_b"))) + F.col("bonus") + 0.0002 >= threshold
    judged = both.filter(gate).withColumns(parts).filter(F.col("proceeding") | able)
    # the later article in cluster order is compared with the earlier one
    score = similarity_of(F.col("jaccard"), F.col("containment"), ratio(F.col("title_f_b"), F.col("title_f_a"))) + F.col("bonus")
    score = F.when(F.col("proceeding"), F.greatest(score, F.lit(threshold))).otherwise(score)
    return judged.select("a", "b", F.round(score, 4).alias("score")).withColumn("passes", F.col("score") >= threshold)


def kind_of() -> Column:
    """A digest of every column that pairs are judged by."""
    return F.sha2(F.to_json(F.struct(*[c for c in PAIR_COLUMNS if c != "article_id"])), 256)


def entries(rows: DataFrame) -> DataFrame:
    """Articles alike in every column that pairs are judged by (rows have ``_kind``, see ``kind_of``) are one entry, under their smallest
    id, with ``n`` articles."""
    made = rows.groupBy("_kind").agg(F.min_by(F.struct(*[F.col(c) for c in PAIR_COLUMNS]), "article_id").alias("r"), F.count("*").alias("n"))
    return made.select("_kind", "r.*", "n")


#: Entries and passing pairs of a cell; one day of a component is never cut.
CELL = 200_000
DECIDED = "article_id string, entry string, at long, c long, cluster_id string"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decides what can be decided in whole cells, which come one after another: first their entries (``at`` is -1) with neighbours
    and the clusters they are in, then their undecided articles in order. An article joins the cluster whose first fitting
    member scores best so far, clusters in the order of their first articles, or begins its own; it can do so once
    no entry that it passes with has an earlier article that is undecided. Others come out without a cluster."""
    cell, around, far, places, waiting, names = None, {}, {}, {}, set(), {}
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (row["component"], row["cell"]) != cell:
                cell, around, far, places, waiting, names = (row["component"], row["cell"]), {}, {}, {}, set(), {}
            entry, at = row["entry"], row["at"]
            if at < 0:
                around[entry], far[entry] = row["around"], row["far"]
                places[entry] = {p["c"]: p["at"] for p in row["places"]}
                names |= {p["c"]: p["cluster_id"] for p in row["places"]}
                names |= {p["c"]: p["cluster_id"] for n in row["far"] for p in n["places"]}
                continue
            if any(n["entry"] in waiting for n in around[entry]) or any(n["next"] is not None and n["next"] < at for n in far[entry]):
                waiting.add(entry)
                out.append((row["article_id"], entry, at, None, None))
                continue
            fitting = [(c, place, n["score"]) for n in around[entry] for c, place in places[n["entry"]].items()]
            fitting += [(p["c"], p["at"], n["score"]) for n in far[entry] for p in n["places"]]
            best, best_score, done = None, 0.0, None
            for c, _, score in sorted(fitting):
                if c != done and score > best_score:
                    best, best_score, done = c, score, c
            best = at if best is None else best
            places[entry].setdefault(best, at)
            out.append((row["article_id"], entry, at, best, names.setdefault(best, row["article_id"])))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], names=[x.split()[0] for x in DECIDED.split(", ")])


def _order(df: DataFrame) -> list[Column]:
    """Official, trusted, older, title (CL2)."""
    rank = quality_of(F.col("source_type"), RANKS)
    return [(~F.col("is_official")).alias("_o1"), (-rank).alias("_o2"), F.coalesce(F.unix_seconds("published"), F.lit(0)).alias("_o3"), F.col("title").alias("_o4")]


def _cells(entry_days: DataFrame, both: DataFrame, size: int) -> DataFrame:
    """(entry, component, cell): each component cut, between days, where about ``size`` entries and pairs have come together."""
    weight = both.groupBy("entry").agg((F.count("*") + 1).alias("weight"))
    rows = entry_days.join(weight, "entry")
    days = rows.groupBy("component", "day").agg(F.sum("weight").alias("weight"))
    before = F.sum("weight").over(Window.partitionBy("component").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))  # a row a day
    cut = days.select("component", "day", F.floor(F.coalesce(before, F.lit(0)) / size).alias("cell"))
    return rows.join(cut, ["component", "day"]).select("entry", "component", "cell")


def greedy(articles: DataFrame, entry_days: DataFrame, passing: DataFrame, size: int = CELL) -> DataFrame:
    """(article_id, entry, at, c, cluster_id) of the one greedy order, run in rounds over cells (CL2). ``articles`` has article_id, entry
    and ``at``, their place in the order; ``entry_days`` (entry, component, day); ``passing`` (a, b, score) pairs of entries, a = b
    where an entry's own articles pass.

    A cell is a stretch of days of one component. A round takes each cell that is not done through a task, which decides all it can; what
    it needs of other cells (the neighbours across a border, with the clusters they are in and their first undecided article) is
    joined to it. The first undecided article of a component can always be decided, so rounds end; as pairs lie within
    days, they are as many as the borders that decisions cross one after another, not as the articles. Neighbours
    are sent once for each entry. Each round is written; the number of undecided articles reaches the driver."""
    turned = passing.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "score")
    both = passing.unionByName(turned).select(F.col("a").alias("entry"), F.col("b").alias("other"), "score")
    cells = written(_cells(entry_days, both, size))
    sides = both.join(cells, "entry").join(cells.selectExpr("entry AS other", "cell AS other_cell"), "other")
    near = written(sides.filter("cell = other_cell").groupBy("entry").agg(F.collect_list(F.struct(F.col("other").alias("entry"), "score")).alias("around")))
    across = written(sides.filter("cell <> other_cell").select("entry", "other", "score"))
    undecided = written(articles.join(cells, "entry").select("article_id", "entry", "at", "component", "cell"))
    decided, spot = None, "array<struct<c:long,cluster_id:string,at:long>>"
    empty = F.array().cast(spot)
    while True:
        left = undecided.select("component", "cell").distinct()
        rows = cells.join(left, ["component", "cell"], "left_semi").join(near, "entry", "left")
        first = undecided.groupBy(F.col("entry").alias("other")).agg(F.min("at").alias("next"))
        held = across.join(rows.select("entry"), "entry", "left_semi").join(first, "other", "left")
        if decided is None:
            rows, held = rows.withColumn("places", empty), held.withColumn("places", empty)
        else:
            spots = decided.groupBy("entry", "c", "cluster_id").agg(F.min("at").alias("at")).groupBy("entry").agg(F.collect_list(F.struct("c", "cluster_id", "at")).alias("places"))
            rows = rows.join(spots, "entry", "left")
            held = held.join(spots.withColumnRenamed("entry", "other"), "other", "left")
        far = held.groupBy("entry").agg(F.collect_list(F.struct("next", "score", F.coalesce("places", empty).alias("places"))).alias("far"))
        rows = rows.join(far, "entry", "left").select(
            "component", "cell", "entry", F.lit(-1).cast("long").alias("at"), F.lit("").alias("article_id"), F.coalesce("places", empty).alias("places"),
            F.coalesce("around", F.array().cast("array<struct<entry:string,score:double>>")).alias("around"), F.coalesce("far", F.array().cast(f"array<struct<next:long,score:double,places:{spot}>>")).alias("far"),
        )
        dealt = rows.unionByName(undecided, allowMissingColumns=True).repartition("component", "cell").sortWithinPartitions("component", "cell", "at")
        made = written(dealt.select(*rows.columns).mapInArrow(_decide, DECIDED))
        done = made.filter("c is not null")
        decided = done if decided is None else decided.unionByName(done)
        if made.filter("c is null").isEmpty():
            return decided
        undecided = written(undecided.join(made.filter("c is null").select("article_id"), "article_id", "left_semi"))


def cluster(rows: DataFrame, ratio=sequence_ratio, threshold: float = THRESHOLD, days: int = WINDOW_DAYS, proceeding_days: int = PROCEEDING_DAYS, size: int = CELL) -> DataFrame:
    """(article_id, cluster_id, position) of every row; a cluster is named by its first article (CL2). Places in the order and
    positions in clusters are numbered by range partitions, so that neither a component nor a cluster is one task's. What is needed of the rows
    is written first: they are gone over again and again."""
    rows = written(rows.select(*PAIR_COLUMNS, "source_type", "published", "title").withColumn("_kind", kind_of()))  # titles are folded once
    table = written(entries(rows))
    single = {"ratio": ratio, "threshold": threshold, "days": days, "proceeding_days": proceeding_days}
    own = _scored(table.filter("n > 1").select(F.col("article_id").alias("a"), F.col("article_id").alias("b")), table, **single)
    passing = written(scored_pairs(table, **single).unionByName(own).filter("passes").select("a", "b", "score"))
    groups = components(passing.select("a", "b")).withColumnRenamed("node", "entry")
    paired = passing.select(F.explode(F.array("a", "b")).alias("entry")).distinct()
    entry_days = paired.join(groups, "entry", "left").join(table.select(F.col("article_id").alias("entry"), "day"), "entry").withColumn("component", F.coalesce("component", "entry"))
    places = in_order(rows.select("article_id", "_kind", *_order(rows)), ["_o1", "_o2", "_o3", "_o4", "article_id"]).select("article_id", "_kind", "at")
    ordered = written(places.join(table.select("_kind", F.col("article_id").alias("entry")), "_kind").select("article_id", "entry", "at"))
    made = numbered(greedy(ordered, written(entry_days), passing, size), ["c"], ["at"], "n").select("article_id", "cluster_id", (F.col("n") - 1).alias("position"))
    alone = rows.select("article_id").join(made, "article_id", "left_anti").select("article_id", F.col("article_id").alias("cluster_id"), F.lit(0).cast("long").alias("position"))
    return made.unionByName(alone)


def _lead_order() -> Column:
    return F.struct((~F.col("is_official")).alias("a"), (-quality_of(F.col("source_type"), RANKS)).alias("b"), (-F.length("title")).alias("c"), F.col("position"), F.col("article_id"))


def _lead() -> Column:
    return F.min_by(F.struct("article_id", "title", "summary", "source_name"), _lead_order()).alias("lead")


def leads(members: DataFrame) -> DataFrame:
    """The lead of each cluster: official, trusted, longest title, first (CL3)."""
    return members.groupBy("cluster_id").agg(_lead())


def events(members: DataFrame) -> DataFrame:
    """One row for each cluster (CL4, CL6, CL7): ``members`` has the prepared columns, cluster_id and position."""
    source = F.struct((-quality_of(F.col("source_type"))).alias("minus"), "title", "url", "source_domain", "source_type", "published", "is_official")
    ordered = F.array_sort(F.collect_list(F.struct("position", "categories")))
    facts = members.groupBy("cluster_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tickers")))).alias("tickers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("direct")))).alias("direct"),
        F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["categories"]))).alias("all_categories"), F.min("day").alias("event_date"), F.count("*").alias("article_count"),
        F.count_distinct("source_domain").alias("source_count"), F.bool_or("is_official").alias("has_official"), F.array_sort(F.collect_list(source)).alias("sources"), _lead(),
    )
    real = F.filter("all_categories", lambda c: c != "OTHER")
    words = F.array_sort(F.slice(F.array_distinct(text.canonical_tokens(text.fold(F.col("lead.title")))), 1, 6))
    kinds = F.slice(F.when(F.size(real) > 0, real).otherwise(F.col("all_categories")), 1, 5)
    scope = F.when(F.size("direct") == 1, F.get("direct", F.lit(0))).when(F.size("tickers") == 1, F.get("tickers", F.lit(0))).otherwise("GLOBAL")
    out = facts.withColumns({"event_types": kinds, "title": F.col("lead.title"), "summary": F.substring("lead.summary", 1, 600), "primary_source": F.col("lead.source_name"), "scope": scope})
    key = F.concat_ws("|", F.array_join("tickers", ","), F.array_join(F.slice(F.array_sort("event_types"), 1, 2), ","), F.array_join(words, " "))
    return out.withColumn("cluster_key", key).drop("lead", "all_categories")


def with_ids(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``event_id`` of scope, year and a sequence that goes on from the store's (CL5), in order of day and cluster. Rows are numbered by
    range partitions, so that a busy scope's year is not one task's; they are written before, as ranges are found by a pass of their own."""
    rows = numbered(written(events.withColumn("year", F.year("event_date"))), ["scope", "year"], ["event_date", "cluster_id"], "n")
    if stored is not None:
        last = stored.groupBy("scope", "year").agg(F.max("sequence").alias("last"))
        rows = rows.join(last, ["scope", "year"], "left").withColumn("n", F.col("n") + F.coalesce("last", F.lit(0)))
    return rows.withColumn("n", F.col("n").cast("int")).withColumn("event_id", F.format_string("EVENT-%s-%d-%04d", "scope", "year", "n")).withColumnRenamed("n", "sequence")


def suppressive_flags(members: DataFrame, names: list[str], earlier: DataFrame | None = None) -> DataFrame:
    """(cluster_id, flags): a flag holds if the lead has it or a third of the headlines do (CL8). ``earlier`` has cluster_id
    and the flags of headlines that a story carried in earlier runs; they vote with the others and never lead."""
    votes = members.select("cluster_id", _lead_order().alias("_lead"), *names)
    if earlier is not None:
        known = earlier.join(members.select("cluster_id").distinct(), "cluster_id", "left_semi")
        votes = votes.unionByName(known.select("cluster_id", *names), allowMissingColumns=True)
    lead = lambda n: F.min_by(n, "_lead")
    return votes.groupBy("cluster_id").agg(*[(F.coalesce(lead(n), F.lit(False)) | (F.sum(F.coalesce(n, F.lit(False)).cast("int")) * 3 >= F.count("*"))).alias(n) for n in names])


def strongest_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """The closest link of each cluster and ticker, the first of equals (CL9)."""
    both = links.join(members.select("article_id", "cluster_id", "position"), "article_id")
    rows = F.struct(*[F.col(c) for c in links.columns])
    return both.groupBy("cluster_id", F.col("ticker").alias("_t")).agg(F.min_by(rows, F.struct((-F.col("rank")).alias("r"), F.col("position"), F.col("article_id"))).alias("l")).select("cluster_id", "l.*")
