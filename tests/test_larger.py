"""Registered queries against their SQL on small tables that have what larger ones have."""

import duckdb
import pytest

from newsloom.queries import all_oracles, all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def compared(spark, tmp_path):
    """Runs a query and its SQL over the smallest tables, of which some are replaced by the rows of a statement."""

    def run(name, **replaced):
        con = duckdb.connect()
        for table in "supplier orders events documents pages".split():
            con.execute(f"copy ({replaced.get(table, 'from given').replace('given', repr(f'{FOLDER}/{table}.parquet'))}) to '{tmp_path}/{table}.parquet' (format parquet)")
            con.execute(f"create view {table} as from '{tmp_path}/{table}.parquet'")
        result = con.sql(all_oracles()[name])
        got = all_queries()[name](spark, str(tmp_path)).select(*result.columns).collect()
        return sorted(map(tuple, got), key=str), sorted(result.fetchall(), key=str)

    return run


def test_fact_terms_of_a_company_with_many(compared):
    got, want = compared("fact_terms", supplier="select s.* replace (k as s_suppkey, 3 as s_nationkey) from (from given limit 1) s, range(1200) r(k)")
    assert len(want) == 1202 and got == want


def test_store_find_existing_with_many_of_a_key(compared):
    orders = "select o.* replace (case when o_orderkey % 50 = 0 then 0 else 0 + 5500 * (o_orderkey % 3) end as o_custkey, timestamp '1996-03-01' as o_orderdate, 'F' as o_orderstatus) from given o"
    got, want = compared("store_find_existing", orders=orders)
    assert len(want) > 5 and got == want


def test_event_ids_in_each_year(compared):
    got, want = compared("event_ids", documents="select * replace (doc_id * 301 as doc_id) from given")
    assert len({w[1].split("-")[2] for w in want}) > 2 and got == want


def test_page_releases_of_pages_with_one_address(compared):
    pages = "select p.* replace (page_id + k * 100000 as page_id, case when k = 2 then replace(html, '</a>', ' x</a>') else html end as html) from given p, range(3) r(k)"
    got, want = compared("page_releases", pages=pages)
    assert len(want) > 20 and got == want


@pytest.mark.parametrize("key", ["k", ""])
def test_equal_titles_are_scored_once(spark, key):
    """Stored and incoming events with few titles: the ratio runs once for two titles, whether keys match or not."""
    import datetime as dt

    from pyspark.sql import functions as F

    from newsloom.operators import store

    scored = spark.sparkContext.accumulator(0)

    def ratio(a, b):
        @F.udf("double")
        def counted(x, y):
            scored.add(1)
            return 1.0 if x == y else 0.5

        return counted(a, b)

    titles = ["Acme wins solar order", "Acme opens solar plant"]
    event = lambda n: (f"E{n:03d}", titles[n % 2], key, dt.date(2026, 9, 1) + dt.timedelta(days=n % 5), ["A"], ["T"])
    kind = "event_id string, title string, cluster_key string, event_date date, event_types array<string>, tickers array<string>"
    made = spark.createDataFrame([event(n) for n in range(120)], kind)
    got = store.find_existing(made.filter("event_id >= 'E080'"), made.filter("event_id < 'E080'"), ratio=ratio).collect()
    assert {(r["incoming_id"], r["event_id"]) for r in got} == {(f"E{n:03d}", f"E{n % 2:03d}") for n in range(80, 120)} and scored.value <= 8
    scored_self = store.find_existing(made, made, ratio=ratio).filter("incoming_id in ('E000', 'E001', 'E002')").collect()
    assert {(r["incoming_id"], r["event_id"]) for r in scored_self} == {("E000", "E002"), ("E001", "E003"), ("E002", "E000")}


def test_copies_of_a_title_are_not_paired(compared, monkeypatch):
    """Of one publisher's 600 copies of a title the survivors are found without listing their pairs."""
    from newsloom.operators import dedup

    rows, written = [], dedup.written

    def counted(df):
        made = written(df)
        rows.append(made.count())
        return made

    monkeypatch.setattr(dedup, "written", counted)
    documents = "select d.* replace (k as doc_id, 'src7' as source, d.text || repeat('x', (k % 4)::int) as text) from (from given order by doc_id limit 1) d, range(600) r(k)"
    got, want = compared("dedup_near_full", documents=documents)
    assert got == want and len(want) == 1 and max(rows) <= 600


def test_pairs_of_copies_meet_once(compared, monkeypatch):
    """All pairs of 300 copies and of titles near to them, in tiles; what meets by words are the different sets of words."""
    from newsloom.operators import dedup

    met, candidates = [], dedup.near_candidates

    def counted(*args):
        made = candidates(*args)
        met.append(made.count())
        return made

    monkeypatch.setattr(dedup, "near_candidates", counted)
    monkeypatch.setattr(dedup, "TILE", 40, raising=False)
    documents = "select doc_id: k, d.* exclude (doc_id, source, text), source: 'src7', text: 'attion thanedble anea eriner thanea therhean esndha edenen' || case when k % 3 = 0 then ' eringble' else '' end from (from given limit 1) d, range(300) r(k)"
    got, want = compared("dedup_near_jaccard", documents=documents)
    assert got == want and len(want) == 300 * 299 // 2 and sum(met) <= 1


def test_pairs_that_share_too_few_words_are_left_out_first(compared, monkeypatch):
    """Sixty titles of one company's days that share one word of eight: nothing else of them is joined; the pairs that pass do not change."""
    from newsloom.operators import cluster

    joined, scored = [], cluster._scored

    def counted(pairs, *args, **more):
        joined.append(pairs.count())
        return scored(pairs, *args, **more)

    monkeypatch.setattr(cluster, "_scored", counted)
    far = "select k as doc_id, d.* exclude (doc_id, source, text), 'src7' as source, 'attion ' || array_to_string([chr(97 + (k % 26)::int) || chr((97 + k // 26)::int) || 'word' || chr(97 + j::int) for j in range(7)], ' ') as text from (from given limit 1) d, range(60) r(k)"
    got, want = compared("cluster_pairs", documents=far)
    assert got == want == [] and sum(joined) == 0
    got, want = compared("cluster_pairs", documents=far.replace("k % 26", "k % 3"))
    assert got == want and len(want) > 0


def test_entities_go_over_texts_once(compared, monkeypatch):
    """Aliases and further names are found in one pass over the texts."""
    from newsloom.operators import lexicon

    passes, marked = [], lexicon.marked

    def counted(*args):
        passes.append(args)
        return marked(*args)

    monkeypatch.setattr(lexicon, "marked", counted)
    got, want = compared("entity_fallback")
    assert got == want and len(want) > 50 and len(passes) == 1
