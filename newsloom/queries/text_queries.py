"""Text, URL and date expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import dates, text, urls
from newsloom.operators import dedup, signals
from newsloom.queries.base import ARTICLES, TEXTS, TYPES, articles, canonical_sql, fold_sql, has_sql, likeness_sql, ratio_sql, rows_of, table, texts, values_sql, words_sql
from newsloom.sources import html

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


@query(f"WITH {ARTICLES} SELECT doc_id, trim(regexp_replace(regexp_replace(replace(replace(replace(lower(title), '&amp;', '&'), '&#39;', ''''), '&quot;', '\"'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS title_key FROM a")
def normalize_title(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", text.normalize_title(F.col("title")).alias("title_key"))


@query(f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query(f"WITH {TEXTS} SELECT doc_id, array_to_string([w for w in string_split(text_f, ' ') if length(w) > 2 and w not in {words_sql(text.STOPWORDS)}], ' ') AS words FROM t")
def content_words(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.array_join(text.content_tokens(F.col("text_f")), " ").alias("words"))


@query(f"WITH {TEXTS} SELECT doc_id, array_to_string({canonical_sql('text_f')}, ' ') AS words FROM t")
def canonical_words(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.array_join(text.canonical_tokens(F.col("text_f")), " ").alias("words"))


_STEM = "CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT regexp_matches(w, '(ss|us|is|as|os|ys)$') THEN substr(w, 1, length(w) - 1) ELSE w END"


@query(f"WITH {TEXTS} SELECT doc_id, array_to_string([{_STEM} for w in string_split(head_f, ' ') if w <> ''], ' ') AS stems FROM t")
def stem_words(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.array_join(F.transform(text.tokens(F.col("head_f")), text.stem), " ").alias("stems"))


@query(f"""WITH {TEXTS}, c AS (SELECT doc_id, {canonical_sql('head_f')} AS w FROM t)
    SELECT doc_id, array_to_string(list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)), '|') AS runs FROM c""")
def title_shingles(spark, sf_dir):
    words = text.canonical_tokens(F.col("head_f"))
    return texts(spark, sf_dir).withColumn("w", words).select("doc_id", F.array_join(F.array_sort(text.shingles(F.col("w"))), "|").alias("runs"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({fold_sql('text')}, '\\d+(?:[.,]\\d+)?'))), ' ') AS numbers FROM documents")
def numeric_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(text.numeric_tokens(text.fold(F.col("text")))), " ").alias("numbers"))


@query(f"WITH {ARTICLES} SELECT doc_id, substr(sha1(concat_ws('||', source_domain, title)), 1, 16) AS id FROM a")
def stable_ids(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", text.stable_id(F.col("source_domain"), F.col("title")).alias("id"))


@query(f"""WITH {TEXTS}, f AS (SELECT doc_id, {fold_sql('text')} AS f FROM documents)
    SELECT doc_id, regexp_matches(f, '\\d+(?:\\.\\d+)?\\s*(?:%|per cent|percent)') OR {has_sql('f', text.MAGNITUDE_WORDS)} OR (regexp_matches(f, '\\d') AND {has_sql('f', text.MAGNITUDE_UNITS)}) AS large FROM f""")
def magnitude_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.has_magnitude(text.fold(F.col("text"))).alias("large"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B') || ' ' || day(o_orderdate) || ' ' || year(o_orderdate) AS d, lower(strftime(o_orderdate, '%B')) || ' ' || day(o_orderdate) || ' ' || year(o_orderdate) AS stated FROM orders")
def stated_deadlines(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("d", F.date_format("o_orderdate", "MMMM d yyyy"))
    said = F.concat(F.lit("Claims close on "), F.regexp_replace("d", r" (\d+) ", r" $1, "), F.lit(" at noon"))
    return rows.select("o_orderkey", "d", F.array_join(text.stated_deadlines(text.fold(said)), ";").alias("stated"))


@query("SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&ndash;', '-'), '&hellip;', '...'), '[\\s\\x{a0}]+', ' ', 'g'))) AS digest FROM pages")
def clean_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.clean_text(F.col("html"))).alias("digest"))


@query(f"""WITH {ARTICLES}, s AS (SELECT doc_id, title || ' - ' || CASE doc_id % 3 WHEN 0 THEN 'The Daily Wire' WHEN 1 THEN 'One two three four five six seven eight' ELSE 'Ends here.' END AS full_title, title FROM a)
    SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'The Daily Wire' ELSE '' END AS publisher, CASE WHEN doc_id % 3 = 0 THEN trim(title) ELSE full_title END AS headline FROM s WHERE title <> ''""")
def publisher_suffix(spark, sf_dir):
    end = F.when(F.col("doc_id") % 3 == 0, "The Daily Wire").when(F.col("doc_id") % 3 == 1, "One two three four five six seven eight").otherwise("Ends here.")
    rows = articles(spark, sf_dir).filter("title <> ''").withColumn("full_title", F.concat("title", F.lit(" - "), end))
    return rows.select("doc_id", text.publisher_of(F.col("full_title")).alias("publisher"), text.headline_of(F.col("full_title")).alias("headline"))


@query(f"""WITH {TEXTS}, c AS (SELECT doc_id, list_distinct({canonical_sql('head_f')}) AS w FROM t)
    SELECT x.doc_id, CASE WHEN len(x.w) > 0 AND len(y.w) > 0 THEN round(len(list_intersect(x.w, y.w)) / len(list_distinct(list_concat(x.w, y.w))), 6) ELSE 0 END AS jaccard,
           CASE WHEN least(len(x.w), len(y.w)) > 0 THEN round(len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)), 6) ELSE 0 END AS contained
    FROM c x JOIN c y ON y.doc_id = x.doc_id + 1""")
def title_overlap(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", F.array_distinct(text.canonical_tokens(F.col("head_f"))).alias("w"))
    both = rows.join(rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v")), "doc_id")
    return both.select("doc_id", F.round(text.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"), F.round(text.containment(F.col("w"), F.col("v")), 6).alias("contained"))


_PAIR = "SELECT x.doc_id AS id, x.head_f AS a, y.head_f AS b FROM c x JOIN c y ON y.doc_id = x.doc_id + 1"


@query(f"""WITH RECURSIVE {TEXTS}, c AS (SELECT doc_id, head_f, list_distinct({canonical_sql('head_f')}) AS w FROM t), {ratio_sql(_PAIR)},
    n AS (SELECT x.doc_id, len(list_intersect(x.w, y.w)) AS n, len(x.w) AS a, len(y.w) AS b FROM c x JOIN c y ON y.doc_id = x.doc_id + 1)
    SELECT doc_id, {likeness_sql('n', 'a', 'b', 'ratio')} AS similarity FROM n JOIN ratios ON id = doc_id""")
def title_similarity(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", "head_f", F.array_distinct(text.canonical_tokens(F.col("head_f"))).alias("w"))
    both = rows.join(rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"), F.col("head_f").alias("next_f")), "doc_id")
    return both.select("doc_id", dedup.similarity_of(text.jaccard(F.col("w"), F.col("v")), text.containment(F.col("w"), F.col("v")), dedup.sequence_ratio("head_f", "next_f")).alias("similarity"))


_PHRASES = ["attion", "thanea", "of the", "onin the", "erou"]


@query(f"WITH {TEXTS} SELECT doc_id, concat_ws('|', {', '.join(f'''CASE WHEN {has_sql('text_f', [p])} THEN '{p}' END''' for p in sorted(_PHRASES, key=lambda p: (-len(p), p)))}) AS terms FROM t")
def matched_phrases(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.array_join(text.matched_terms(F.col("text_f"), _PHRASES), "|").alias("terms"))


_ADVICE = text.advice_pattern(["attion of", "thea"], ["the", "onin"], ["thing", "erou"])


@query("SELECT doc_id, md5(regexp_replace(text, '" + _ADVICE + "', '[removed]', 'g')) AS digest, regexp_matches(text, '" + _ADVICE + "') AS changed FROM documents")
def advice_redaction(spark, sf_dir):
    clean = text.redact_advice(F.col("text"), pattern=_ADVICE)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("digest"), (clean != F.col("text")).alias("changed"))


_GOOD, _BAD = ["attion", "thing", "ones"], ["erou", "thanea", "hein"]


@query(f"SELECT conv_id, turn, {' + '.join(f'contains({fold_sql('text')}, {chr(39)}{w}{chr(39)})::INTEGER' for w in _GOOD)} - ({' + '.join(f'contains({fold_sql('text')}, {chr(39)}{w}{chr(39)})::INTEGER' for w in _BAD)}) AS sign FROM conversations WHERE role = 'user'")
def polarity(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.select("conv_id", "turn", text.polarity(text.fold(F.col("text")), _GOOD, _BAD).alias("sign"))


_QUERY_SQL = """list_sort(list_distinct([split_part(kv, '=', 1) for kv in string_split(q, '&') if contains(kv, '=') and regexp_replace(kv, '^[^=]*=', '') <> '' and lower(split_part(kv, '=', 1)) not in %s]))""" % words_sql(urls.TRACKING)
_CANONICAL = f"""WITH u AS (SELECT page_id, trim(url) AS url FROM pages),
    p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h, regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM u),
    k AS (SELECT *, {_QUERY_SQL} AS keys FROM p)
    SELECT page_id, s || '://' || h || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(keys) > 0 THEN '?' || array_to_string([x || '=' || regexp_extract('&' || q, '&' || x || '=([^&]+)', 1) for x in keys], '&') ELSE '' END AS canonical FROM k"""


@query(_CANONICAL)
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("SELECT page_id, split_part(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', ''), ':', 1) AS domain, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root FROM pages")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.domain_of(F.col("url")).alias("domain"), urls.site_root(F.col("url")).alias("root"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://go.example.com/r?x=1&url=' || replace(replace(replace(url, '?', '%3F'), '&', '%26'), '=', '%3D') ELSE 'https://go.example.com/r?q=words' END AS wrapped, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN split_part(url, '#', 1) ELSE 'https://go.example.com/r?q=words' END AS target FROM pages")
def unwrap_redirect(spark, sf_dir):
    coded = F.replace(F.replace(F.replace("url", F.lit("?"), F.lit("%3F")), F.lit("&"), F.lit("%26")), F.lit("="), F.lit("%3D"))
    wrapped = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://go.example.com/r?x=1&url="), coded)).otherwise("https://go.example.com/r?q=words")
    return table(spark, sf_dir, "pages").withColumn("wrapped", wrapped).select("page_id", "wrapped", urls.unwrap(F.col("wrapped")).alias("target"))


_DOMAINS = [("example.com", "newspaper"), ("blog.tionble.example.com", "blog"), ("example.org", "trade_publication"), ("tionsh.example.net", "wire")]


@query(f"""WITH d(domain, type) AS ({values_sql(_DOMAINS)}),
    u AS (SELECT page_id, split_part(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', ''), ':', 1) AS source_domain FROM pages)
    SELECT page_id, source_domain, coalesce(arg_max(type, length(domain)), 'unknown') AS source_type FROM u LEFT JOIN d ON source_domain = domain OR ends_with(source_domain, '.' || domain) GROUP BY page_id, source_domain""")
def domain_source_type(spark, sf_dir):
    from newsloom.operators.normalize import with_source_type

    pages = table(spark, sf_dir, "pages").select("page_id", urls.domain_of(F.col("url")).alias("source_domain"))
    return with_source_type(pages, rows_of(spark, _DOMAINS, "domain string, type string")).select("page_id", "source_domain", "source_type")


@query("""SELECT page_id, NOT (regexp_matches(url, '://(?:[^/]*\\.)?example\\.org(?:[/?#]|$)')) AND length(trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/')) >= 8 AS good FROM pages""")
def article_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.looks_like_article(F.col("url"), ["example.org"]).alias("good"))


_FORMS = ["%a, %d %b %Y %H:%M:%S +0530", "%Y-%m-%dT%H:%M:%SZ", "%Y%m%dT%H%M%SZ", "%d-%b-%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%Y-%m-%d", "%d-%m-%Y %H:%M", "no date"]
_JAVA = ["EEE", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyyMMdd'T'HHmmss'Z'", "dd-MMM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy HH:mm"]


@query("SELECT o_orderkey, CASE o_orderkey % 8 WHEN 7 THEN NULL WHEN 0 THEN o_orderdate - to_minutes(330) ELSE o_orderdate END AS parsed FROM orders")
def parse_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey") % 8).withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    written = F.when(F.col("k") == 0, F.concat(F.lit("Tue, "), F.date_format("ts", "dd MMM yyyy HH:mm:ss"), F.lit(" +0530")))
    for k, form in enumerate(_JAVA[1:], start=1):
        written = written.when(F.col("k") == k, F.date_format("ts", form))
    return rows.select("o_orderkey", dates.parse_date(written.otherwise("no date")).cast("timestamp_ntz").alias("parsed"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 36 HOUR OR event_id % 97 = 0")
def lookback_filter(spark, sf_dir):
    when = F.when(F.col("event_id") % 97 != 0, F.col("ts").cast("timestamp"))
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").filter(dates.within_lookback(when, now, 36)).select("event_id")


@query("""WITH l AS (SELECT url AS page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS anchor FROM pages)
    SELECT page_url, regexp_extract(page_url, '^[a-z]+://[^/?#]*') || href AS link, trim(anchor) AS anchor, count(*) AS n FROM l WHERE trim(anchor) <> '' GROUP BY ALL""")
def page_links(spark, sf_dir):
    return html.links(table(spark, sf_dir, "pages")).groupBy("page_url", "link", "anchor").agg(F.count("*").alias("n"))


@query("""SELECT url, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || '/feed.xml' ELSE 'https://feeds.example.com/' || page_id END AS feed FROM pages WHERE page_id % 3 < 2""")
def page_feeds(spark, sf_dir):
    href = F.when(F.col("page_id") % 3 == 0, F.lit("/feed.xml")).otherwise(F.concat(F.lit("https://feeds.example.com/"), F.col("page_id").cast("string")))
    kind = F.when(F.col("page_id") % 3 < 2, "application/rss+xml").otherwise("text/css")
    tag = F.concat(F.lit('<link rel="alternate" type="'), kind, F.lit('" href="'), href, F.lit('">'))
    return html.feeds(table(spark, sf_dir, "pages").withColumn("html", F.concat(tag, "html")))


@query("SELECT page_id, page_id % 4 IN (1, 2) AS missing FROM pages")
def soft_404(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 4 == 1, "https://x.example.com/errors/page-not-found").otherwise("https://x.example.com/news/1")
    body = F.when(F.col("page_id") % 4 == 2, F.concat(F.lit("<h1>Sorry, page not found</h1>"), "html")).otherwise(F.col("html"))
    return pages.select("page_id", html.soft_404(url, F.regexp_replace(body, "404", "405")).alias("missing"))


@query("SELECT url, strlen(html) AS bytes, len(string_split(lower(html), '<a ')) - 1 AS links, CASE WHEN contains(lower(html), '<nav>') THEN 'nav' || CASE WHEN contains(lower(html), 'track(') THEN ',track(' ELSE '' END ELSE '' END AS markers FROM pages")
def page_facts(spark, sf_dir):
    return html.describe(table(spark, sf_dir, "pages"), ["nav", "track(", "captcha"])


@query("SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS title FROM part")
def document_titles(spark, sf_dir):
    name = F.concat(F.lit("https://ir.example.com/files/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_20240131.pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", html.title_of_document(name).alias("title"))
