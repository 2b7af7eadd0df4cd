import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.functions import dates, text, urls
from newsloom.operators import dedup


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize("value, folded", [("Café  Crème", "cafe creme"), ("“It’s”—done!", "it s -done"), ("R&amp;D 4.5%", "r&d 4.5%"), (None, ""), ("Straße u.s.", "straße u.s.")])
def test_fold(spark, value, folded):
    assert one(spark, value, text.fold) == folded


@pytest.mark.parametrize("haystack, phrase, found", [
    ("raises capital", "api", False), ("executive pay", "cut", False), ("charcoal grill", "coal", False), ("solar modules fall", "solar module", True), ("a solar module", "solar modules", True),
    ("usd/inr up", "usd inr", True), ("s&p falls", "s&p", True), ("bus fares", "bus", True), ("e-auction held", "e-auction", True),
])
def test_phrases_keep_to_words(spark, haystack, phrase, found):
    row = spark.createDataFrame([(haystack, phrase)], "h string, p string").select(F.regexp_like("h", text.phrase_pattern(F.col("p"))), text.contains_any(F.col("h"), [phrase])).first()
    assert tuple(row) == (found, found)


def test_canonical_words_and_similarity(spark):
    words = lambda v: one(spark, v, lambda c: text.canonical_tokens(text.fold(c)))
    assert words("Acme bags big order from the United States") == ["acme", "win", "order", "usa"]
    assert words("US cuts duties") == ["usa", "cut", "duty"]
    rows = spark.createDataFrame([("Acme wins large order", "Acme bags major order")], "a string, b string")
    a, b = (F.array_distinct(text.canonical_tokens(text.fold(F.col(c)))) for c in "ab")
    row = rows.select(text.jaccard(a, b), text.containment(a, b), dedup.similarity_of(text.jaccard(a, b), text.containment(a, b), dedup.sequence_ratio(text.fold(F.col("a")), text.fold(F.col("b"))))).first()
    assert row[0] == row[1] == 1.0 and row[2] >= 0.8


def test_clean_text(spark):
    assert one(spark, "<p>A&nbsp;&amp; B&#8217;s &#233;t&#233;</p>", text.clean_text) == "A & B's été"
    assert one(spark, "Plant opens - The Daily Wire", text.publisher_of) == "The Daily Wire"
    assert one(spark, "Plant opens - The Daily Wire", text.headline_of) == "Plant opens"
    assert one(spark, "Ends here - really?", text.publisher_of) == ""


def test_numbers_deadlines_shingles(spark):
    assert one(spark, "up 4.5% to 1,200 and 4.5", text.numeric_tokens) == ["4.5", "1,200"]
    assert one(spark, "Claims by March 5, 2026 or April 1, 2026", lambda c: text.stated_deadlines(text.fold(c))) == ["april 1 2026", "march 5 2026"]
    assert one(spark, "a b c d e", lambda c: text.shingles(F.split(c, " "))) == ["a b c d", "b c d e"]
    assert one(spark, "won 5 gw", text.has_magnitude) and not one(spark, "won the game", text.has_magnitude)


def test_advice_and_json(spark):
    assert one(spark, "Strong buy! Investors should sell the stock.", text.redact_advice) == "[removed]! Investors should [removed]."
    assert one(spark, 'Sure: ```json\n{"a": 1}\n```', text.first_json) == '{"a": 1}'
    assert one(spark, "no object", text.first_json) is None


@pytest.mark.parametrize("url, canonical", [
    ("HTTPS://WWW.Example.com/a/?utm_source=x&b=2&a=1&a=3#f", "https://www.example.com/a?a=1&b=2"), ("https://e.com", "https://e.com/"), ("https://g.com/r?url=https%3A%2F%2Fe.com%2Fx%3Fref%3Dq%26k%3D1", "https://e.com/x?k=1"), ("https://e.com/?q=words", "https://e.com/?q=words"), ("", ""),
])
def test_canonical_url(spark, url, canonical):
    assert one(spark, url, urls.canonical_url) == canonical


def test_url_parts(spark):
    assert one(spark, "http://www.A.co.uk:80/x", urls.domain_of) == "a.co.uk"
    assert one(spark, "a.b.co", urls.suffixes) == ["a.b.co", "b.co"]
    import base64

    token = base64.urlsafe_b64encode(b"\x08\x13https://e.com/story-1\xd2\x01").decode().rstrip("=")
    assert one(spark, f"https://news.example.com/rss/articles/{token}", urls.token_target) == "https://e.com/story-1"
    good = lambda u: one(spark, u, lambda c: urls.looks_like_article(c, ["bad.com"]))
    assert good("https://e.com/story-about-it") and not good("https://x.bad.com/story-about-it") and not good("https://e.com/logo-large.png") and not good("https://e.com/a")


@pytest.mark.parametrize("value, when", [
    ("Tue, 22 Sep 2026 06:00:00 +0530", dt.datetime(2026, 9, 22, 0, 30)), ("Tue, 22 Sep 2026 06:00:00 GMT", dt.datetime(2026, 9, 22, 6)), ("2026-09-22T06:00:00Z", dt.datetime(2026, 9, 22, 6)), ("20260922T060000Z", dt.datetime(2026, 9, 22, 6)),
    ("22-Sep-2026", dt.datetime(2026, 9, 22)), ("22-Sep-2026 10:11:12", dt.datetime(2026, 9, 22, 10, 11, 12)), ("2026-09-22", dt.datetime(2026, 9, 22)), ("soon", None), ("", None), (None, None),
])
def test_dates(spark, value, when):
    assert one(spark, value, lambda c: dates.parse_date(c).cast("timestamp_ntz")) == when
