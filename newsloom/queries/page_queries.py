"""Pages as sources: links as a table function of SQL, section pages, releases, filings, redirects, and normalised articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import normalize
from newsloom.queries.base import ARTICLES, articles, fold_sql, rows_of, table
from newsloom.sources import html

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__], ORACLES[function.__name__] = function, sql
        return function

    return add


#: Anchors of all pages in order, with their absolute address, for pages whose markup is changed first.
_LINKS = """WITH h AS (SELECT page_id, url, {changed} AS html FROM pages),
    l AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS words,
                 generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS place FROM h),
    a AS (SELECT page_id, page_url, regexp_extract(page_url, '^[a-z]+://[^/?#]*') || href AS link, trim(words) AS anchor, place FROM l WHERE trim(words) <> '')"""


def _changed(spark, sf_dir, *pairs: tuple[str, str]):
    """Anchors of the pages, in whose markup some strings are replaced."""
    pages, markup = table(spark, sf_dir, "pages"), F.col("html")
    for old, new in pairs:
        markup = F.replace(markup, F.lit(old), F.lit(new))
    return html.links(pages.withColumn("html", markup), "page_id")


@query(f"{_LINKS.format(changed='html')} SELECT page_id, link, anchor, count(*) AS n FROM a GROUP BY ALL")
def page_links_in_sql(spark, sf_dir):
    """Links by a lateral join with the table function (HT1)."""
    html.register(spark)
    statement = "SELECT p.page_id, l.link, l.anchor, count(*) AS n FROM {pages} p, LATERAL page_links(p.url, p.html) l GROUP BY ALL"
    return spark.sql(statement, pages=table(spark, sf_dir, "pages"))


@query(f"""{_LINKS.format(changed="replace(html, '<a href=\"/', '<a href=\"/press/')")} SELECT DISTINCT page_url, link FROM a WHERE regexp_matches(lower(anchor || ' ' || link), 'investor|announcement|press|media|financial|disclosure')
    AND NOT regexp_matches(lower(anchor || ' ' || link), 'contact|career|privacy|faq') AND NOT ends_with(lower(link), '.pdf') AND link <> page_url""")
def page_sections(spark, sf_dir):
    """Pages of the same host that may list filings (HT5)."""
    return html.sections(_changed(spark, sf_dir, ('<a href="/', '<a href="/press/')))


@query(f"""{_LINKS.format(changed="replace(html, '</a>', ': press release of today</a>')")}, f AS (SELECT *, {fold_sql('anchor')} AS folded FROM a WHERE length(anchor) >= 25)
    SELECT page_url, arg_min(link, (page_id, place)) AS link, arg_min(anchor, (page_id, place)) AS anchor FROM f WHERE contains(folded, 'press release') GROUP BY page_id, page_url, folded""")
def page_releases(spark, sf_dir):
    """Links that read like releases, one for each text and page (SC7)."""
    return html.releases(_changed(spark, sf_dir, ("</a>", ": press release of today</a>")))


@query(f"""{_LINKS.format(changed="replace(html, '</a>', ' quarterly results</a>')")} SELECT arg_min(page_url, (page_url, place)) AS page_url, link, arg_min(anchor, (page_url, place)) AS title FROM a GROUP BY link""")
def page_filings(spark, sf_dir):
    """Links that look like filings, each once (HT6, SC8)."""
    return html.filings(_changed(spark, sf_dir, ("</a>", " quarterly results</a>")))


_LANDED = """d AS (SELECT page_id, 'https://agg.example/' || page_id AS address,
        CASE page_id % 5 WHEN 0 THEN 'https://news.example/final-place-' || page_id WHEN 1 THEN 'https://news.example/refreshed-' || page_id WHEN 2 THEN 'https://news.example/canonical-' || page_id % 40
             WHEN 3 THEN 'https://news.example/in-the-body-' || page_id END AS target FROM pages)"""


def _landed(spark, sf_dir):
    """Landed redirects: each fifth leads nowhere, and canonical links share 40 addresses."""
    pages, part, number = table(spark, sf_dir, "pages"), F.col("page_id") % 5, F.col("page_id").cast("string")
    made = {
        "url": F.concat(F.lit("https://agg.example/"), number),
        "final_url": F.when(part == 0, F.concat(F.lit("https://news.example/final-place-"), number)).otherwise(F.lit("https://agg.example/moved-on")),
        "html": F.when(part == 1, F.concat(F.lit('<meta http-equiv="refresh" content="0;url=https://news.example/refreshed-'), number, F.lit('">')))
        .when(part == 2, F.concat(F.lit('<link rel="canonical" href="https://news.example/canonical-'), (F.col("page_id") % 40).cast("string"), F.lit('">')))
        .when(part == 3, F.concat(F.lit("see https://agg.example/elsewhere and https://news.example/in-the-body-"), number, F.lit(" now")))
        .otherwise(F.lit("<p>https://agg.example/elsewhere https://x.example/short</p>")),
    }
    return pages.select("page_id", *[c.alias(name) for name, c in made.items()])


@query(f"WITH {_LANDED} SELECT page_id, target FROM d")
def redirect_destinations(spark, sf_dir):
    """Where landed redirects lead: final address, refresh, canonical link or the body (HT9)."""
    return _landed(spark, sf_dir).select("page_id", html.destination(F.col("html"), F.col("final_url"), ["agg.example"]).alias("target"))


@query(f"""WITH {_LANDED}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY lpad(page_id::VARCHAR, 9, '0')) AS n FROM (SELECT * FROM d ORDER BY page_id LIMIT 200) WHERE target IS NOT NULL)
    SELECT coalesce(substr(sha1('news.example|story ' || d.page_id), 1, 16), lpad(d.page_id::VARCHAR, 9, '0')) AS article_id, r.target AS url, lpad(d.page_id::VARCHAR, 9, '0') AS previous_id FROM d JOIN r ON r.page_id = d.page_id AND r.n = 1
    UNION ALL SELECT lpad(page_id::VARCHAR, 9, '0'), address, NULL FROM d WHERE page_id NOT IN (SELECT page_id FROM r WHERE n = 1)""")
def redirects_followed(spark, sf_dir):
    """Articles with their redirects followed, within a budget of 200; of several that lead to one address the first takes it (HT10)."""
    landed = _landed(spark, sf_dir)
    stories = landed.select(F.lpad(F.col("page_id").cast("string"), 9, "0").alias("article_id"), "url", F.concat(F.lit("Story "), F.col("page_id").cast("string")).alias("title"))
    return html.resolve(stories, landed.drop("page_id"), ["agg.example"], 200).select("article_id", "url", "previous_id")


_KEY = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH {ARTICLES}, r AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'Report ' || doc_id || ': the ' || source_domain || ' story' END AS headline FROM a)
    SELECT headline AS title, 'https://www.' || source_domain || '/a/' || (doc_id % 700) || '?a=1&b=2' AS url, CASE WHEN doc_id % 4 = 1 THEN 'Given' WHEN doc_id % 4 = 2 THEN source_domain ELSE 'The Daily Wire' END AS source_name, source_domain,
           length(trim(regexp_replace(summary, '[\\s\\x{{a0}}]+', ' ', 'g'))) AS size, substr(sha1(source_domain || '|' || {_KEY.format('headline')}), 1, 16) AS article_id,
           CASE WHEN doc_id % 5 <> 0 THEN 'blog' WHEN source_domain = 'src1.example.com' THEN 'regulator' ELSE 'wire' END AS source_type,
           (doc_id % 5 = 0 AND source_domain = 'src1.example.com') OR doc_id % 6 = 0 AS is_official
    FROM r WHERE headline <> ''""")
def normalized_articles(spark, sf_dir):
    """Raw rows normalised: titles and publishers, addresses, names, types, flags, identity (NM7)."""
    rows, part = articles(spark, sf_dir), lambda n: F.col("doc_id") % n
    number = F.col("doc_id").cast("string")
    head = F.concat(F.lit(" <b>Report</b>  "), number, F.lit(": the&nbsp;"), "source_domain", F.lit(" story"))
    raw = rows.select(
        F.when(part(9) == 0, " ").when(part(4) == 2, head).otherwise(F.concat(head, F.lit(" - The Daily Wire"))).alias("title"), "summary",
        F.concat(F.lit(" HTTPS://WWW."), "source_domain", F.lit("/a/"), part(700).cast("string"), F.lit("/?b=2&utm_source=x&a=1#top")).alias("url"),
        F.when(part(4) == 1, "Given").otherwise("").alias("source_name"), F.lit("").alias("source_domain"), F.when(part(5) != 0, "blog").otherwise("unknown").alias("source_type"), (part(6) == 0).alias("is_official"),
    )
    domains = rows_of(spark, [("src1.example.com", "regulator"), ("example.com", "wire")], "domain string, type string")
    out = normalize.normalize(raw, domains)
    return out.select("title", "url", "source_name", "source_domain", F.length("summary").alias("size"), "article_id", "source_type", "is_official")
