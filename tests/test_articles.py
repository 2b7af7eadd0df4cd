import datetime as dt
import difflib
import random

import pandas as pd
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import cluster, dedup, direction, graph, impact, lexicon, match, normalize, relationship

DAY = dt.datetime(2026, 9, 22, 6)
COLUMNS = "article_id string, title string, summary string, url string, source_name string, source_domain string, source_type string, published timestamp, is_official boolean"


def articles(spark, rows):
    full = [(f"a{k}", r.get("title", "t"), r.get("summary", ""), r.get("url", f"https://d{k}.com/{k}"), r.get("name", ""), r.get("domain", "d.com"), r.get("type", "newspaper"), r.get("published", DAY), r.get("official", False)) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def ids(df):
    return sorted(r["article_id"] for r in df.collect())


def test_best_copy(spark):
    rows = [{"url": "https://e.com/x"}, {"url": "https://E.com/x", "official": True}, {"url": "https://e.com/X", "summary": "longer"}]
    assert ids(dedup.collapse(articles(spark, rows), dedup.url_key())) == ["a1"]
    rows = [{"title": "Same Title!"}, {"title": "same title", "summary": "more"}, {"title": "Same title", "domain": "other.com"}, {"title": "!!!"}, {"title": "???"}]
    assert ids(dedup.collapse(articles(spark, rows), dedup.title_key())) == ["a1", "a2", "a3", "a4"]
    lost = dedup.lineage(articles(spark, [{"url": "https://e.com/x"}, {"url": "https://e.com/x", "official": True}]), dedup.url_key()).first()
    assert (lost["winner"], lost["losers"], lost["n"]) == ("a1", ["https://e.com/x"], 1)


def test_near_duplicates_of_one_publisher(spark):
    a = "Acme Solar wins record module supply order worth 900 crore from utility"
    rows = [{"title": a}, {"title": a.replace("900", "950"), "summary": "longer"}, {"title": a, "domain": "other.com"}, {"title": a + " today", "published": DAY + dt.timedelta(days=40)}, {"title": "Quite another story about coal"}]
    assert ids(dedup.near_duplicates(articles(spark, rows))) == ["a1", "a2", "a3", "a4"]


def test_a_chain_of_near_duplicates_keeps_its_ends(spark):
    words = "harbour granite festival quarter mountain leather bicycle station journal painter village october".split()
    chain = [" ".join(w) for w in (words, [*words[:11], "kingdom"], [*words[:10], "kingdom", "lantern"])]
    assert ids(dedup.near_duplicates(articles(spark, [{"title": t} for t in chain]))) == ["a0", "a2"]
    # a better copy takes the place of the one before, and the next is compared with it
    longer = [{"title": t, "summary": "s" * n} for t, n in zip(chain, (1, 9, 3))]
    assert ids(dedup.near_duplicates(articles(spark, longer))) == ["a1"]


def test_normalise(spark):
    domains = spark.createDataFrame([("e.com", "newspaper"), ("filings.e.com", "exchange_filing")], "domain string, type string")
    rows = [{"title": "<b>Plant</b> opens - The Daily Wire", "url": "https://www.m.e.com/a/?utm_source=z", "type": "unknown"}, {"title": "Notice", "url": "https://x.filings.e.com/1", "type": "unknown"}, {"title": "", "url": "https://e.com/2"}]
    got = {r["title"]: r for r in normalize.normalize(articles(spark, rows), domains).collect()}
    assert set(got) == {"Plant opens", "Notice"}
    r = got["Plant opens"]
    assert (r["url"], r["source_name"], r["source_domain"], r["source_type"], r["is_official"]) == ("https://www.m.e.com/a", "The Daily Wire", "m.e.com", "newspaper", False)
    assert got["Notice"]["is_official"] and len(r["article_id"]) == 16


def test_profiles(spark):
    profiles = spark.createDataFrame([("T", "Acme Ltd", [("acme ltd", "primary"), ("ACME", "secondary"), ("acme", "primary"), (" ", None)]), ("U", "Zed", [])], "ticker string, company string, aliases array<struct<value:string,strength:string>>")
    got = sorted((r["ticker"], r["alias"], r["is_primary"]) for r in normalize.profile_aliases(profiles).collect())
    assert got == [("T", "ACME", False), ("T", "acme ltd", True), ("U", "Zed", True)]
    lists = spark.createDataFrame([("T", "countries", 0, "Chile", None), ("T", "export_markets", 0, "chile", None), ("T", "commodities", 0, "Coal", "output"), ("T", "unknown", 0, "x", None)], "ticker string, field string, pos int, term string, role string")
    assert sorted((r["exposure_type"], r["term"].lower(), r["is_export_market"], r["role"]) for r in normalize.profile_terms(lists).collect()) == [("COMMODITY", "coal", False, "output"), ("GEOGRAPHY", "chile", True, None)]


def texts(spark, rows, **more):
    df = articles(spark, rows).withColumns({"head_f": text.fold(F.col("title")), "text_f": text.fold(F.concat_ws(" ", "title", "summary")), "collector": F.lit("rss"), "tickers_hint": F.array().cast("array<string>")})
    return df.withColumns(more)


def test_classification(spark):
    keywords = spark.createDataFrame([("ORDER_WIN", 0, 0, "bags order"), ("EARNINGS", 1, 0, "quarterly results"), ("TARIFF", 2, 0, "import duty")], "category string, rule_ord int, kw_ord int, phrase string")
    rules = spark.createDataFrame([(9, "ORDER_WIN", "verb", 0, "wins"), (9, "ORDER_WIN", "noun", 0, "contract")], "rule_ord int, category string, side string, ord int, phrase string")
    rows = [{"title": "Acme wins a contract", "summary": "after quarterly results"}, {"title": "Duty", "summary": "import duty rises; bags orders"}, {"title": "Nothing"}]
    got = {r["article_id"]: r["categories"] for r in lexicon.classify(texts(spark, rows), lexicon.rule_classifier(keywords, rules)).collect()}
    assert got == {"a0": ["ORDER_WIN", "EARNINGS"], "a1": ["ORDER_WIN", "TARIFF"], "a2": ["OTHER"]}
    lexicon.register_classifier("fixed", lambda t: t.select("article_id", F.array(F.lit("MACRO")).alias("categories")))
    assert lexicon.classify(texts(spark, rows), "fixed").count() == 3


def company(spark):
    aliases = spark.createDataFrame([("RAV", "Ravel", True, [], ["ravel electronics"]), ("COAL", "Coal India", True, [], []), ("BANK", "First", False, ["bank"], [])], "ticker string, alias string, is_primary boolean, requires array<string>, excludes array<string>")
    names = spark.createDataFrame([("COAL", "Northern Mines", "subsidiary", 0, [])], "ticker string, name string, strength string, pos int, excludes array<string>")
    flags = "role string, is_export_market boolean, is_international boolean, is_associate boolean, excludes array<string>"
    rows = [("COAL", "COMMODITY", "thermal coal", "output", False, False, False, []), ("COAL", "COMPETITOR", "Essar", None, False, False, False, []), ("COAL", "CUSTOMER", "power producers", None, False, False, False, []), ("COAL", "INDUSTRY", "mining", None, False, False, False, []), ("COAL", "GEOGRAPHY", "India", None, False, False, False, []), ("COAL", "REGULATION", "coal ministry", None, False, False, False, [])]
    return aliases, names, spark.createDataFrame(rows, f"ticker string, exposure_type string, term string, {flags}")


def test_entities(spark):
    aliases, names, _ = company(spark)
    rows = [{"title": "Ravel Electronics opens shop"}, {"title": "Ravel opens shop near Ravel Electronics"}, {"title": "First quarter"}, {"title": "First opens a bank"}, {"title": "Output up", "summary": "at Northern Mines"}, {"title": "Coal India output"}]
    got = {(r["article_id"], r["ticker"], r["strength"], r["in_headline"]) for r in match.entities(texts(spark, rows), aliases, names).collect()}
    assert got == {("a1", "RAV", "primary", True), ("a3", "BANK", "secondary", True), ("a4", "COAL", "subsidiary", False), ("a5", "COAL", "primary", True)}
    why = {(r["article_id"], r["reason"]) for r in match.rejections(match.alias_hits(texts(spark, rows), aliases)).collect()}
    assert why == {("a0", "alias appears only inside an excluded phrase"), ("a2", "required context term absent")}
    hinted = texts(spark, [{"title": "Board meeting"}], collector=F.lit("nse"), tickers_hint=F.array(F.lit("coal"), F.lit("zz")))
    assert [(r["ticker"], r["in_headline"]) for r in match.entities(hinted, aliases, names).collect()] == [("COAL", True)]


def links(spark, rows, categories):
    aliases, names, terms = company(spark)
    base = texts(spark, rows)
    facts = base.withColumns({"categories": F.array(*[F.lit(c) for c in categories]), "listing_page": F.lit(False), "query_kind": F.lit(None).cast("string")})
    return relationship.links(match.entities(base, aliases, names), match.exposure_summary(match.exposures(base, terms)), facts)


def test_relationships(spark):
    rows = [{"title": "Coal India profit"}, {"title": "Essar to build plant", "summary": "Coal India is named below"}, {"title": "Thermal coal prices surge"}, {"title": "Weather in India"}, {"title": "Power producers meet"}, {"title": "Essar and mining and thermal coal; power producers"}, {"title": "Nothing at all"}]
    got = {(r["article_id"], r["ticker"]): r for r in links(spark, rows, ["COMMODITY", "NEW_PLANT"]).collect()}
    label = {k[0]: v["relationship"] for k, v in got.items()}
    assert label["a0"] == "DIRECT" and label["a1"] == "INDIRECT_STRONG" and label["a2"] == "INDIRECT_STRONG" and label["a4"] == "SECTOR" and label["a5"] == "INDIRECT_STRONG"
    assert "a3" not in label and "a6" not in label
    assert all(r["reasons"] for r in got.values()) and "Named only in passing" in got["a1", "COAL"]["reasons"]
    assert all(r["relationship"] != "DIRECT" or r["alias"] for r in got.values())


def prepared(spark, rows, direct=("T",)):
    facts = texts(spark, rows).withColumns({"categories": F.array(F.lit("ORDER_WIN")), "legal_notice": F.lit(False)})
    rel = facts.select("article_id", F.lit("T").alias("ticker"), F.lit("DIRECT" if direct else "SECTOR").alias("relationship"))
    return cluster.prepared(facts, rel)


STORY = [{"title": "Acme wins 900 crore solar module order", "official": True}, {"title": "Acme bags solar module order worth 900 crore"}, {"title": "Acme secures module order for solar plant"}, {"title": "Acme appoints finance chief"}, {"title": "Acme wins 900 crore solar module order", "published": DAY + dt.timedelta(days=9)}]


def test_one_story_is_one_event(spark):
    seen = []
    for parts in (1, 7):
        rows = prepared(spark, STORY).repartition(parts)
        got = cluster.cluster(rows)
        seen.append(sorted((r["cluster_id"], r["article_id"]) for r in got.collect()))
    assert seen[0] == seen[1]
    groups = {}
    for c, a in seen[0]:
        groups.setdefault(c, []).append(a)
    assert sorted(map(sorted, groups.values())) == [["a0", "a1", "a2"], ["a3"], ["a4"]]
    members = rows.join(got, "article_id")
    events = {r["cluster_id"]: r for r in cluster.with_ids(cluster.events(members)).collect()}
    assert events["a0"]["article_count"] == 3 and events["a0"]["title"] == STORY[0]["title"] and events["a0"]["event_id"].startswith("EVENT-T-2026-")


def test_clusters_are_those_of_a_pass_over_all_pairs(spark):
    """Every pair by brute force, with the sequence ratio, notices with deadlines and equal articles."""
    draw = random.Random(5)
    pool = [" ".join(draw.choice("solar order plant steel coal export duty merger audit grid".split()) for _ in range(draw.randint(2, 6))) for _ in range(14)]
    notices = ["shareholder alert class action deadline october 5 2026", "investor alert lead plaintiff deadline october 5 2026", "class action deadline november 9 2026"]
    rows = [{"title": draw.choice(pool + notices), "type": draw.choice(["wire", "blog", "regulator"]), "published": DAY + dt.timedelta(days=draw.randint(0, 6)), "official": draw.random() < 0.2} for _ in range(70)]
    facts = texts(spark, rows).withColumns({"categories": F.array(F.when(F.length("title") % 2 == 0, "ORDER_WIN").otherwise("OTHER")), "legal_notice": F.regexp_like("text_f", F.lit("alert|class action"))})
    links = facts.select("article_id", F.explode(F.when(F.substring("article_id", 2, 9).cast("int") % 3 == 0, F.array(F.lit("T"), F.lit("U"))).otherwise(F.array(F.lit("T")))).alias("ticker"), F.when(F.col("legal_notice") | (F.length("title") % 3 == 0), "DIRECT").otherwise("SECTOR").alias("relationship"))
    ready = cluster.prepared(facts, links)
    a = {r["article_id"]: r for r in ready.collect()}

    def passes(x, y):
        """Score of a passing pair, else 0; the smaller id is the second text of the ratio."""
        x, y = sorted((a[x], a[y]), key=lambda r: r["article_id"])
        shared, days = set(x["direct"]) & set(y["direct"]), abs((x["day"] - y["day"]).days)
        notice = x["legal_notice"] and y["legal_notice"] and shared
        if not set(x["tickers"]) & set(y["tickers"]) or (notice and x["deadlines"] and y["deadlines"] and not set(x["deadlines"]) & set(y["deadlines"])):
            return 0
        if days > (30 if notice else 3) or (x["direct"] and y["direct"] and not shared):
            return 0
        u, v = set(x["words"]), set(y["words"])
        contained = len(u & v) / min(len(u), len(v)) if u and v else 0
        jaccard = len(u & v) / len(u | v) if u and v else 0
        likeness = round(max(0.5 * jaccard + 0.3 * difflib.SequenceMatcher(None, y["title_f"], x["title_f"]).ratio() + 0.2 * contained, 0.8 * contained), 4)
        kinds = (set(x["categories"]) & set(y["categories"])) - {"OTHER"}
        score = likeness + min(0.3, 0.12 * bool(kinds) + 0.08 * (days == 0) + 0.08 * (x["is_official"] or y["is_official"]) + 0.06 * bool(shared))
        score = round(max(score, 0.62) if notice else score, 4)
        return score if score >= 0.62 else 0

    clusters = []
    for i in sorted(a, key=lambda k: (not a[k]["is_official"], -cluster.RANKS[a[k]["source_type"]], a[k]["published"], a[k]["title"], k)):
        best, most = None, 0
        for c in clusters:
            score = next((s for m in c if (s := passes(i, m)) > most), None)
            if score is not None:
                best, most = c, score
        clusters.append([i]) if best is None else best.append(i)
    got = {(r["article_id"], r["cluster_id"], r["position"]) for r in cluster.cluster(ready).collect()}
    assert got == {(m, c[0], k) for c in clusters for k, m in enumerate(c)}
    assert {tuple(r) for r in cluster.cluster(ready, size=25).select("article_id", "cluster_id", "position").collect()} == got  # in several cells
    assert 3 < len(clusters) < 60 and cluster.cluster(ready.limit(0)).count() == 0


def scored(spark, **changes):
    kind = "array<struct<minus:double,exposure_type:string,term:string,relationship:string,role:string,in_headline:boolean,is_export_market:boolean,is_international:boolean>>"
    row = {"relationship": "DIRECT", "rank": 5, "categories": ["ORDER_WIN"], "source_types": ["exchange_filing"], "n_sources": 3, "head_f": "acme wins record order of 900 crore", "text_f": "", "evidence_weight": 6.0, "international": False, "is_international": False, "is_update": False, "in_headline": True, "official_language": False, "is_lender": False}
    row |= {f: False for f in impact.PENALTIES} | {"exposures": []} | changes
    types = {"categories": "array<string>", "source_types": "array<string>", "rank": "int", "n_sources": "int", "evidence_weight": "double", "exposures": kind}
    schema = ", ".join(f"{k} {types.get(k, 'boolean' if isinstance(v, bool) else 'string')}" for k, v in row.items())
    return direction.with_direction(impact.scored(spark.createDataFrame([tuple(row.values())], schema))).first()


def test_scores_and_their_reasons(spark):
    r = scored(spark)
    assert (r["impact_score"], r["impact_band"], r["direction"]) == (15, "CRITICAL", "POSITIVE")
    points = [int(x.split()[0]) for x in r["score_reasons"]]
    assert min(15, max(0, sum(points))) == 15
    r = scored(spark, relationship="SECTOR", rank=2, categories=["TARIFF"], source_types=["blog"], n_sources=1, head_f="duty talk", opinion=True, in_headline=False)
    assert r["impact_score"] == 0 and r["impact_band"] == "NOISE" and r["direction"] == "UNCERTAIN"
    r = scored(spark, relationship="MACRO", rank=1, categories=["TARIFF", "TENDER"], in_headline=False, is_international=True)
    assert r["impact_score"] == 8 and r["score_reasons"][-1].startswith("capped at 8")


def test_direction_by_role(spark):
    goods = lambda role: [(-2.5, "COMMODITY", "copper", "INDIRECT", role, True, False, False)]
    case = lambda role, head: scored(spark, relationship="INDIRECT", rank=3, categories=["COMMODITY"], exposures=goods(role), head_f=head, in_headline=False)["direction"]
    assert case("input", "copper prices surge on supply cuts") == "NEGATIVE"
    assert case("output", "copper prices surge on supply cuts") == "POSITIVE"
    assert case("throughput", "copper prices fall") == "UNCERTAIN"
    rival = [(-2.5, "COMPETITOR", "Zed", "INDIRECT", None, True, False, False)]
    assert scored(spark, relationship="INDIRECT", rank=3, categories=["OTHER"], exposures=rival, head_f="zed fined after probe")["direction"] == "POSITIVE"


def sequential(order, edges):
    """One pass over all articles, each with its own entry: cluster (by its first article) and position of each."""
    near = {}
    for a, b, score in edges:
        near.setdefault(a, []).append((b, score))
        near.setdefault(b, []).append((a, score))
    clusters, of = [], {}
    for x in order:
        best, most, done = None, 0.0, None
        for c, place, score in sorted((*of[y], s) for y, s in near.get(x, ()) if y in of):
            if c != done and score > most:
                best, most, done = c, score, c
        if best is None:
            best = len(clusters)
            clusters.append([])
        of[x] = (best, len(clusters[best]))
        clusters[best].append(x)
    return {x: clusters[c][0] for x, (c, _) in of.items()}


def test_greedy_order_of_one_large_component_in_many_tasks(spark):
    """A component of 100,000 entries over a thousand days, cut into cells: the clusters are those of the one order."""
    draw, n = random.Random(17), 100_000
    day = [k // 100 for k in range(n)]
    edges = [(k, k + draw.choice([1, 2, 7, 90]), round(draw.uniform(0.62, 1.2), 4)) for k in range(n - 90)] + [(k, k + 1, 0.7) for k in range(n - 91, n - 1)]
    edges = [(a, b, s) for (a, b), s in {(a, b): s for a, b, s in edges}.items()]
    rank = list(range(n))
    draw.shuffle(rank)
    name = lambda k: f"e{k:06d}"
    spread = lambda rows, schema: spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]), schema)
    articles = spread([(name(k), name(k), rank[k]) for k in range(n)], "article_id string, entry string, at long")
    days = spread([(name(k), "one", DAY.date() + dt.timedelta(days=day[k])) for k in range(n)], "entry string, component string, day date")
    passing = spread([(name(a), name(b), s) for a, b, s in edges], "a string, b string, score double")
    cells = cluster._cells(days, passing.selectExpr("a AS entry").unionByName(passing.selectExpr("b AS entry")), 20_000)
    assert 10 < cells.select("cell").distinct().count() < 30
    got = {r["article_id"]: r["cluster_id"] for r in cluster.greedy(articles, days, passing, 20_000).select("article_id", "cluster_id").collect()}
    want = sequential(sorted(range(n), key=rank.__getitem__), edges)
    assert got == {name(k): name(c) for k, c in want.items()}


def test_numbers_are_row_numbers(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["A", "B", None]), draw.randrange(50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, d int, k int").repartition(7)
    got = {r["k"]: r["n"] for r in graph.numbered(df, ["g"], ["d", "k"], "n").collect()}
    for g in ("A", "B", None):
        assert [got[k] for _, k in sorted((d, k) for x, d, k in rows if x == g)] == list(range(1, sum(x == g for x, _, _ in rows) + 1))
    assert graph.numbered(df.limit(0), ["g"], ["d", "k"], "n").count() == 0


def survivors(rows):
    """Near-duplicates by all pairs: better articles first, each meets the last kept one that it is alike to."""
    kept = []
    words = {r["id"]: set(r["words"]) for r in rows}

    def alike(x, y):
        x, y = sorted((x, y), key=lambda r: r["id"])
        u, v = words[x["id"]], words[y["id"]]
        if x["domain"] != y["domain"] or not u or not v or (x["when"] and y["when"] and abs(x["when"] - y["when"]) > dt.timedelta(days=5)):
            return False
        jaccard, contained = len(u & v) / len(u | v), len(u & v) / min(len(u), len(v))
        ratio = difflib.SequenceMatcher(None, x["folded"], y["folded"]).ratio()
        return round(max(0.5 * jaccard + 0.3 * ratio + 0.2 * contained, 0.8 * contained), 4) >= dedup.SIMILARITY

    merit = lambda r: (r["official"], normalize.QUALITY[r["type"]], r["when"] is not None, len(r["summary"]))
    for r in sorted(rows, key=lambda r: (not r["official"], -normalize.QUALITY[r["type"]], r["when"] or dt.datetime(1970, 1, 1), r["id"])):
        met = next((k for k in reversed(range(len(kept))) if alike(r, kept[k])), None)
        if met is None:
            kept.append(r)
        elif merit(r) > merit(kept[met]):
            kept[met] = r
    return sorted(r["id"] for r in kept)


def test_near_duplicates_of_random_titles_by_all_pairs(spark):
    draw = random.Random(23)
    base = [draw.sample("solar order plant steel coal export duty merger audit grid cement power bonds fund".split(), 9) for _ in range(6)]
    rows = []
    for _ in range(160):
        words = list(draw.choice(base))
        if draw.random() < 0.6:
            words[draw.randrange(9)] = draw.choice(["profit", "loss", "bank", words[0]])
        rows.append({"title": " ".join(words), "domain": draw.choice(["d.com", "D.com", "e.org"]), "type": draw.choice(["wire", "blog", "regulator"]), "official": draw.random() < 0.2, "summary": "x" * draw.randint(0, 3), "published": None if draw.random() < 0.1 else DAY + dt.timedelta(hours=draw.randint(0, 900))})
    made = articles(spark, rows)
    got = ids(dedup.near_duplicates(made))
    folded = made.select("article_id", text.fold(F.col("title")).alias("f"), F.array_distinct(text.canonical_tokens(text.fold(F.col("title")))).alias("w")).collect()
    facts = {r["article_id"]: r for r in folded}
    plain = [{"id": r["article_id"], "domain": r["source_domain"].lower(), "type": r["source_type"], "official": r["is_official"], "summary": r["summary"], "when": r["published"], "folded": facts[r["article_id"]]["f"], "words": facts[r["article_id"]]["w"]} for r in made.collect()]
    assert got == survivors(plain) and 20 < len(got) < 150


def test_candidates_grow_with_the_years(spark):
    """A publisher's history meets itself in stretches of days only: twice the years, twice the candidates."""

    def candidates(years):
        keys = spark.range(years * 365 * 4).select(F.col("id").cast("string").alias("article_id"), F.lit("d").alias("domain"), F.lit("w").alias("word"), F.lit(5).alias("n"), (F.col("id") * 21_600_000_000).alias("day"))
        return dedup.near_candidates(keys, 5, 0.76).count()

    few, many = candidates(2), candidates(4)
    assert 1.8 * few < many < 2.2 * few and few < 2 * 365 * 4 * 60
