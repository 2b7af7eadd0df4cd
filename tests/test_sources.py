import json
import time

from pyspark.sql import functions as F

from newsloom.sources import html, landing


def put(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_feeds(spark, tmp_path):
    item = "<item><title>A</title><link>https://e.com/a</link><pubDate>Tue, 22 Sep 2026 06:00:00 GMT</pubDate><source url='x'>Wire</source></item><item><title>no link</title></item>"
    rows = landing.rss(spark, put(tmp_path, "f.xml", f"<rss><channel>{item}</channel></rss>")).collect()
    assert [(r["title"], r["source_name"], str(r["published"])) for r in rows] == [("A", "Wire", "2026-09-22 06:00:00")]
    entry = "<feed><entry><title>B</title><link href='https://e.com/b'/><updated>2026-09-22T06:00:00Z</updated></entry></feed>"
    assert [r["url"] for r in landing.atom(spark, put(tmp_path, "g.xml", entry)).collect()] == ["https://e.com/b"]


def test_exchange_payloads(spark, tmp_path):
    profiles = spark.createDataFrame([("ACME", "Acme Ltd")], "ticker string, company string")
    path = put(tmp_path, "n.json", {"data": [{"symbol": "ACME", "desc": "Order", "attchmntFile": "https://e.com/1.pdf", "an_dt": "22-Sep-2026 10:00:00"}, {"symbol": "ZZ", "desc": "x"}]})
    assert [(r["title"], r["tickers_hint"], r["is_official"]) for r in landing.exchange_announcements(spark, path, profiles).collect()] == [("Acme Ltd: Order", ["ACME"], True)]
    listed = put(tmp_path, "l.json", [{"symbol": "ACME", "subject": "Results", "fileName": "f"}])
    assert [r["title"] for r in landing.exchange_announcements(spark, listed, profiles).collect()] == ["Acme Ltd: Results"]
    codes = spark.createDataFrame([("500", "ACME", "Acme Ltd"), ("501", "ZED", "Zed Ltd")], "code string, ticker string, company string")
    (tmp_path / "b").mkdir()
    put(tmp_path / "b", "1.json", {"Table": [{"SLONGNAME": "Acme Ltd", "SCRIP_CD": "500", "HEADLINE": "H", "ATTACHMENTNAME": "a.pdf"}]})
    put(tmp_path / "b", "2.json", {"Table": [{"SLONGNAME": "Wrong Company", "SCRIP_CD": "501", "HEADLINE": "H"}]})
    assert [r["title"] for r in landing.second_exchange(spark, str(tmp_path / "b"), codes, "https://e.com/").collect()] == ["Acme Ltd: H"]


def test_posts_and_index(spark, tmp_path):
    posts = {"data": {"children": [{"data": {"title": "T", "score": 5, "created_utc": 1790000000, "permalink": "/r/x", "subreddit": "x"}}, {"data": {"title": "adult", "over_18": True, "score": 9}}, {"data": {"title": "low", "score": 0}}, {"data": {"title": "old", "score": 9, "created_utc": 0}}, None, {}]}}
    got = landing.forum(spark, put(tmp_path, "p.json", posts), "https://f.com", 1).collect()
    assert [(r["title"], r["published"] is None, r["consumer"]) for r in got] == [("T", False, True), ("old", True, True)]
    videos = {"items": [{"id": {"videoId": "v"}, "snippet": {"title": "A &amp; B"}}, {"id": {}, "snippet": {"title": "x"}}]}
    assert [(r["title"], r["url"]) for r in landing.videos(spark, put(tmp_path, "v.json", videos), "https://v.com/").collect()] == [("A & B", "https://v.com/v")]
    index = {"articles": [{"url": "u", "title": "t", "domain": "d", "seendate": "20260922T060000Z"}, {"url": None, "title": "x"}]}
    assert [str(r["published"]) for r in landing.document_index(spark, put(tmp_path, "i.json", index)).collect()] == ["2026-09-22 06:00:00"]


def test_event_files(spark, tmp_path):
    (tmp_path / "2026" / "T").mkdir(parents=True)
    put(tmp_path / "2026" / "T", "a.json", {"event_id": "E", "title": "t", "stocks": {"T": {"impact_score": 5}}, "extra": 1})
    put(tmp_path / "2026" / "T", "bad.json", "{broken")
    got = landing.event_files(spark, str(tmp_path)).collect()
    assert [(r["event_id"], r["stocks"]["T"]["impact_score"]) for r in got] == [("E", 5)]


PAGE = """<html><head><link rel="alternate" type="application/rss+xml" href="/feed"></head><body><a href="/inv/investors">Investor relations</a><a href='annual_report_2025_20250101.pdf'>Download</a>
<a href="https://other.com/x">Quarterly results</a><a href="mailto:x">mail</a><a href="/c">Careers investor</a><a href="/e"></a></body></html>"""


def test_pages(spark):
    pages = spark.createDataFrame([("https://ir.e.com/home", PAGE), ("https://z.com", None)], "url string, html string")
    found = html.links(pages)
    assert [r["link"] for r in found.orderBy("place").collect()] == ["https://ir.e.com/inv/investors", "https://ir.e.com/annual_report_2025_20250101.pdf", "https://other.com/x", "https://ir.e.com/c"]
    assert [r["feed"] for r in html.feeds(pages).collect()] == ["https://ir.e.com/feed"]
    assert [r["link"] for r in html.sections(found).collect()] == ["https://ir.e.com/inv/investors"]
    assert {r["title"] for r in html.filings(found).collect()} == {"Annual Report 2025"}
    split = html.segment(["annual", "report", "board", "meeting"])
    assert spark.createDataFrame([("annualreport xyz",)], "t string").select(split("t")).first()[0] == "annual report xyz"


def test_redirects(spark):
    rows = [("a1", "https://agg.com/1", "T1"), ("a2", "https://agg.com/2", "T2"), ("a3", "https://e.com/kept-as-is", "T3")]
    articles = spark.createDataFrame(rows, "article_id string, url string, title string")
    landed = spark.createDataFrame([("https://agg.com/1", "https://agg.com/1", '<link rel="canonical" href="https://e.com/long-story">'), ("https://agg.com/2", "https://e.com/long-story", "")], "url string, final_url string, html string")
    got = {r["title"]: (r["url"], r["previous_id"]) for r in html.resolve(articles, landed, ["agg.com"], 5).collect()}
    assert got == {"T1": ("https://e.com/long-story", "a1"), "T2": ("https://agg.com/2", None), "T3": ("https://e.com/kept-as-is", None)}


def test_anchors_in_one_scan(spark):
    page = 'x <a href=one>A <b>b</b></a><A HREF = "two">open <a href=\'three\'>T &amp; u</A ><a name=n>none</a><abbr href=no>x</abbr><a href="http://[bad">z</a><a href="/4">unclosed'
    assert list(html.anchors("https://e.com/d/", page)) == [(0, "https://e.com/d/one", "A b"), (1, "https://e.com/d/three", "T &amp; u")]
    assert list(html.anchors(None, None)) == list(html.anchors("https://e.com", "<a href=x")) == []
    pages = spark.createDataFrame([("https://e.com/d/", page), ("https://e.com", None)], "url string, html string")
    html.register(spark)
    rows = spark.sql("SELECT p.url AS page_url, l.place, l.link, l.anchor FROM {p} p, LATERAL page_links(p.url, p.html) l", p=pages)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, html.links(pages).collect()))
    for piece in ("<a href=x>", "<a ", "<a href=", "<a>b</a>", "<", "<a href=x>" + "<" * 50, "</a>"):
        begun = time.perf_counter()
        list(html.anchors("https://e.com", piece * (500_000 // len(piece)) + "</a>"))
        assert time.perf_counter() - begun < 6, piece
