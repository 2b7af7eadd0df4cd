import json

import pytest

from newsloom.sources import landing, seam
from newsloom.streaming import streams


def feed(k):
    items = "".join(f"<item><title>Title {k} {j}</title><link>https://e.com/{k}/{j % 2}</link><pubDate>Mon, 0{j + 1} Jan 2024 10:00:00 GMT</pubDate></item>" for j in range(3))
    return f"<rss><channel>{items}<item><title></title><link>x</link></item></channel></rss>"


def posts(k):
    return json.dumps({"data": {"children": [{"data": {"title": f"Post {k} {j}", "permalink": f"/p/{k}/{j}", "subreddit": "s", "score": j, "created_utc": 1.7e9 + j, "over_18": j == 2}} for j in range(4)]}})


def index(k):
    return json.dumps({"articles": [{"url": f"https://e.com/{k}", "title": f"Found {k}", "domain": "e.com", "seendate": "20240105T101500Z"}, {"title": "no address"}]})


def found(k):
    return json.dumps({"items": [{"id": {"videoId": f"v{k}"}, "snippet": {"title": "A &amp; B", "channelTitle": "c", "publishedAt": "2024-01-02T03:04:05Z"}}]})


CASES = {"feed": (feed, "xml", {}, 12), "forum": (posts, "json", {"base_url": "https://f", "least_score": 1}, 8), "index": (index, "json", {}, 4), "videos": (found, "json", {"base_url": "https://v/"}, 4)}


def run(df, path, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query, df.sparkSession.table(name)


@pytest.mark.parametrize("name", sorted(CASES))
def test_stream_and_table_hold_the_same(spark, tmp_path, name):
    made, ending, options, rows = CASES[name]
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.{ending}").write_text(made(k))
    batch = seam.landed(spark, name, str(folder), **options)
    query, stream = run(seam.landed(spark, name, str(folder), stream=True, files_per_batch=1, **options), tmp_path / "c", f"seam_{name}")
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    key = lambda r: str(r)
    assert sorted(batch.collect(), key=key) == sorted(stream.collect(), key=key) and batch.count() == rows


def test_stream_feeds_the_seen_filter(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.xml").write_text(feed(0))
    articles = seam.landed(spark, "feed", str(folder), stream=True)
    _, kept = run(streams.fresh(articles, "url", "published"), tmp_path / "c", "seam_fresh")
    assert sorted(r["url"] for r in kept.collect()) == ["https://e.com/0/0", "https://e.com/0/1"]


def test_rejected_records_and_unknown_names(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.json").write_text(index(0))
    (folder / "1.json").write_text("{not json")
    table = seam.rejected(spark, str(folder), landing.INDEX, multiLine="true")
    _, stream = run(seam.rejected(spark, str(folder), landing.INDEX, stream=True, multiLine="true"), tmp_path / "c", "seam_rejected")
    assert table.collect() == stream.collect() and len(table.collect()) == 1
    with pytest.raises(KeyError):
        seam.landed(spark, "nowhere", str(folder))
