import pytest
from pyspark.sql import functions as F

from newsloom.functions import text
from newsloom.operators import isolation, report
from newsloom.plans import daily
from newsloom.queries.article_queries import linked_of
from newsloom.queries.base import articles
from newsloom.sources import landing

LANDED = "article_id string, title string, url string, published string, payload string"
BAD = [
    ("b1", "Fine", "https://[bad/1", "2026-09-22", "{}"), ("b2", "Fine", "https://x.com/1", "2026-13-45", "{}"), ("b3", "Fine", "https://x.com:99999/", "99/99/99", "{oops"),
    ("b4", "Fine", "no address", None, '{"is_official": "x"}'),
]


def landed(spark, n):
    rows = articles(spark, "/root/testdata/sf0.001").filter(F.col("doc_id") < n)
    payload = F.to_json(F.struct("summary", "source_type", "is_official"))
    return rows.select("article_id", "title", "url", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), payload.alias("payload"))


def bad_rows(spark):
    rows = spark.createDataFrame(BAD, LANDED)
    return rows.unionByName(rows.limit(1).withColumns({"article_id": F.lit("b5"), "title": F.unhex(F.lit("C328")).cast("string"), "url": F.lit("https://x.com/2")}))


def test_failures_are_named_by_stage_and_reason(spark):
    blank = spark.createDataFrame([("g1", None, None, " ", None), ("g2", "T", "http://h", "", "")], LANDED)
    good, failures = daily.isolated(bad_rows(spark).unionByName(blank))
    assert sorted((r["article_id"], r["published"], r["summary"], r["source_type"], r["is_official"]) for r in good.collect()) == [("g1", None, "", "unknown", False), ("g2", None, "", "unknown", False)]
    assert sorted((r["article_id"], r["stage"], r["reason"]) for r in failures.collect()) == [
        ("b1", "url", "ValueError: Invalid IPv6 URL"), ("b2", "date", "no known form: 2026-13-45"), ("b3", "date", "no known form: 99/99/99"), ("b3", "json", "not the expected JSON: {oops"),
        ("b3", "url", "ValueError: Port out of range 0-65535"), ("b4", "json", 'not the expected JSON: {"is_official": "x"}'), ("b4", "url", "ValueError: no host"), ("b5", "title", "not UTF-8"),
    ]
    outcome = isolation.summary(failures, "article_id", 7)
    assert report.diagnostics(outcome).first()["status"] == "FAILED"
    assert outcome.first()["succeeded"] == 2 and outcome.first()["note"] == "b1: ValueError: Invalid IPv6 URL; b2: no known form: 2026-13-45"


def test_a_run_is_that_of_the_good_rows(spark):
    """The whole assessment with bad rows ends, and equals the one without them."""

    def run(rows):
        good, failures = daily.isolated(rows)
        good = good.withColumns({"head_f": text.fold(F.col("title")), "text_f": text.fold(F.concat_ws(" ", "title", "summary"))})
        scored = daily.assess(*linked_of(spark, good))
        return sorted(map(str, scored.select("event_id", "ticker", "relationship", "impact_score", "direction", "confidence").collect())), failures.count()

    clean = landed(spark, 40)
    want, none = run(clean)
    assert none == 0 and len(want) > 10
    assert run(clean.unionByName(bad_rows(spark))) == (want, 8)


def test_too_many_failures_end_the_run(spark):
    rows = bad_rows(spark)
    with pytest.raises(ValueError, match="5 of 5 rows"):
        daily.isolated(rows, most=0.5)
    good, failures = daily.isolated(rows.limit(0), most=0.5)
    assert good.count() == failures.count() == 0
    assert isolation.summary(failures, "article_id", 0).first()["ok"]


def test_python_functions_carry_their_error(spark):
    half = isolation.attempt(lambda n, by: n // by, "long")
    rows = spark.createDataFrame([(8, 2), (8, 0), (9, 2)], "n long, by long").withColumn("r", half(F.col("n"), F.col("by")))
    assert [tuple(r) for r in rows.select("r.value", "r.error").collect()] == [(4, None), (None, "ZeroDivisionError: integer division or modulo by zero"), (4, None)]


def test_unreadable_payloads_are_named(spark, tmp_path):
    for name, content in {"a": '{"articles": [{"url": "u", "title": "t"}]}', "b": '{"articles": [', "c": '{"articles": 7}'}.items():
        (tmp_path / f"{name}.json").write_text(content)
    bad = landing.unreadable(spark, str(tmp_path), landing.INDEX, multiLine="true").collect()
    assert sorted((r["file"][-6:], r["reason"]) for r in bad) == [("b.json", '{"articles": ['), ("c.json", '{"articles": 7}')]
    assert landing.document_index(spark, str(tmp_path)).count() == 1


def test_odd_character_references(spark):
    rows = spark.createDataFrame([("a&#9999999;b&#55296;c&#0;d&#169;",)], "t string")
    assert rows.select(text.clean_text(F.col("t"))).first()[0] == "a�b�c�d©"
