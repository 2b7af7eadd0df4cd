"""Landed HTML pages as rows (HT1-HT11, SC7, SC8). ``pages`` has url and html."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import text, urls

ANCHOR_TAG = re.compile(r"<(/?)a(?![A-Za-z0-9_-])", re.I)
HREF = re.compile(r"""\bhref\s*+=\s*+(?:"([^"]*+)|'([^']*+)|([^\s>"']++))""", re.I)
MARKUP = re.compile(r"<[^<>]*+>")
LINK_TAG = re.compile(r"<link\b[^>]*>", re.I)
# Words of error pages, of releases and filings, of links that say nothing, and document endings.
SOFT_404_PATHS = ["404", "error", "notfound", "page-not-found"]
SOFT_404_TEXT = ["page not found", "404", "page you are looking for", "does not exist"]
RELEASE_HINTS = ["press release", "notification", "circular", "order", "scheme", "tender", "policy"]
FILING_HINTS = ["result", "annual report", "quarterly", "outcome", "announcement", "presentation", "disclosure", "press release", "notice", "intimation", "financial"]
SECTION_HINTS, SECTION_SKIP = ["investor", "announcement", "press", "media", "financial", "disclosure"], ["contact", "career", "privacy", "faq"]
GENERIC_ANCHORS = ["download", "view", "click here", "read more", "pdf", "here", "open", "more"]
DOCUMENTS = r"\.(?:pdf|docx?|xlsx?|pptx?|zip)$"


def anchors(base: str | None, page: str | None) -> Iterator[tuple[int, str, str]]:
    """(place, link, anchor) of a page's http anchors with text, in one scan: an anchor's text runs to its end tag, and an anchor that opens
    before takes its place. A tag ends at the first >; behind the last > there is none."""
    page, at, place, href, start = page or "", 0, 0, None, 0
    while found := ANCHOR_TAG.search(page, at):
        end = page.find(">", found.end())
        if end < 0:
            return
        at = end + 1
        if not found[1]:
            link = HREF.search(page[found.end() : end])
            href, start = next((g for g in link.groups() if g is not None), None) if link else None, at
            continue
        words, target, href = " ".join(MARKUP.sub(" ", page[start : found.start()]).split()) if href else "", href, None
        if not words:
            continue
        try:
            target = urljoin(base or "", target.strip())
        except ValueError:
            continue
        if target.startswith(("http://", "https://")):
            yield place, target, words
            place += 1


def _anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(key, base, *a) for key, base, page in zip(frame["page"], frame["url"], frame["html"]) for a in anchors(base, page)]
        yield pd.DataFrame(rows, columns=["page", "page_url", "place", "link", "anchor"])


def links(pages: DataFrame, key: str | None = None) -> DataFrame:
    """(page_url, place, link, anchor) of http anchors with text, absolute (HT1). With ``key``, a column of the pages, there is also ``page``, its
    value as a string, by which pages of one address are told apart."""
    rows = pages.select(F.col(key or "url").cast("string").alias("page"), "url", "html")
    found = rows.mapInPandas(_anchors, "page string, page_url string, place int, link string, anchor string").withColumn("anchor", text.clean_text(F.col("anchor")))
    return found if key else found.drop("page")


class PageLinks:
    """The same as a table function of SQL: ``FROM pages p, LATERAL page_links(p.url, p.html) l``. Character references are decoded here."""

    def eval(self, base: str, page: str):
        for place, link, words in anchors(base, page):
            yield place, link, " ".join(unescape(words).split())


def register(spark: SparkSession) -> None:
    """Makes ``page_links`` known to the session's SQL."""
    spark.udtf.register("page_links", F.udtf(PageLinks, returnType="place int, link string, anchor string"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _feeds(base: pd.Series, pages: pd.Series) -> pd.Series:
    def found(url, page):
        tags = [t for t in LINK_TAG.findall(page or "") if re.search(r"""rel\s*=\s*["']?alternate""", t, re.I) and re.search(r"application/(?:rss|atom)\+xml", t, re.I)]
        hrefs = [m for t in tags if (m := re.search(r"""href\s*=\s*["']?([^"'\s>]+)""", t, re.I))]
        return list(dict.fromkeys(urljoin(url or "", m[1]) for m in hrefs))

    return pd.Series([found(u, p) for u, p in zip(base, pages)])


def feeds(pages: DataFrame) -> DataFrame:
    """(url, feed) of the feeds that pages announce (HT2)."""
    return pages.select("url", F.explode(_feeds("url", "html")).alias("feed"))


def soft_404(url: Column, html: Column) -> Column:
    """A page that answers but says it isn't there (HT4): an error path, or such words near its beginning."""
    path = F.lower(urls.parts(url)["path"])
    bad_path = F.regexp_like(path, F.lit(rf"(?:^|[/\-_.])(?:{'|'.join(SOFT_404_PATHS)})(?:$|[/\-_.])"))
    head = F.substring(text.fold(text.clean_text(html)), 1, 1500)
    return bad_path | text.contains_any(head, SOFT_404_TEXT)


def releases(found: DataFrame, least: int = 25) -> DataFrame:
    """Links of a government page that read like releases, one for each text and page (SC7)."""
    rows = found.withColumn("folded", text.fold(F.col("anchor"))).filter((F.length("anchor") >= least) & text.contains_any(F.col("folded"), RELEASE_HINTS))
    page = [c for c in ("page", "page_url") if c in rows.columns]
    return rows.groupBy(*page, "folded").agg(F.min_by(F.struct("place", "link", "anchor"), "place").alias("l")).select("page_url", "l.link", "l.anchor")


def sections(found: DataFrame) -> DataFrame:
    """Pages of the same host that may list filings (HT5)."""
    low = F.lower(F.concat_ws(" ", "anchor", "link"))
    hint, skip = F.regexp_like(low, F.lit("|".join(SECTION_HINTS))), F.regexp_like(low, F.lit("|".join(SECTION_SKIP)))
    same = urls.domain_of(F.col("page_url")) == urls.domain_of(F.col("link"))
    return found.filter(hint & ~skip & same & ~F.lower("link").endswith(".pdf") & (F.col("link") != F.col("page_url"))).select("page_url", "link").distinct()


def is_generic(anchor: Column) -> Column:
    return F.trim(text.fold(anchor)).isin(GENERIC_ANCHORS) | (F.length(F.trim(anchor)) < 4)


def title_of_document(url: Column) -> Column:
    """A title out of a document's name (HT7): stamps and endings off, CamelCase and separators to words."""
    name = F.regexp_replace(F.element_at(F.split(urls.parts(url)["path"], "/"), -1), DOCUMENTS, "")
    name = F.regexp_replace(F.coalesce(F.try_url_decode(name), name), r"(?:^|[_\-])\d{8,14}(?=$|[_\-])|[_\-]v?\d{1,2}$", " ")
    name = F.regexp_replace(F.regexp_replace(name, r"[_\-+.]+", " "), r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=\d{4})", " ")
    return F.initcap(F.trim(F.regexp_replace(name, r"\s+", " ")))


def segment(words: list[str]):
    """A column function that splits run-together words by a vocabulary, all of it or nothing (HT7)."""
    known = set(words)

    def cut(word: str) -> str:
        best: list[list[str] | None] = [[]]
        for end in range(1, len(word) + 1):
            options = [best[start] + [word[start:end]] for start in range(max(0, end - 24), end) if best[start] is not None and word[start:end].lower() in known]
            best.append(min(options, key=len) if options else None)
        return " ".join(best[-1]) if best[-1] else word

    @F.pandas_udf(T.StringType())
    def split(titles: pd.Series) -> pd.Series:
        return titles.map(lambda t: None if t is None else " ".join(cut(w) for w in t.split()))

    return split


def filings(found: DataFrame, hints: list[str] = FILING_HINTS) -> DataFrame:
    """Links of a company's page that look like filings, with the best title (HT6, SC8)."""
    rows = found.withColumn("title", F.when(is_generic(F.col("anchor")), title_of_document(F.col("link"))).otherwise(F.col("anchor")))
    recognised = F.regexp_like(text.fold(F.col("title")), F.lit("|".join(hints)))
    document = F.regexp_like(F.lower(urls.parts(F.col("link"))["path"]), F.lit(DOCUMENTS))
    same = urls.domain_of(F.col("page_url")) == urls.domain_of(F.col("link"))
    kept = rows.filter((document | same) & recognised)
    return kept.groupBy("link").agg(F.min_by(F.struct("page_url", "title"), F.struct("page_url", "place")).alias("b")).select("b.page_url", "link", "b.title")


def destination(html: Column, final_url: Column, blocked: list[str]) -> Column:
    """Where a landed redirect leads (HT9): the final address, a refresh, a canonical or data link, else the
    first acceptable address in the body."""
    patterns = [r'(?i)http-equiv="?refresh"?[^>]*url=([^"\'>\s]+)', r'(?i)<link[^>]+rel="?canonical"?[^>]+href="([^"]+)"', r'(?i)data-n-au="([^"]+)"', r'(?i)window\.location(?:\.href)?\s*=\s*["\']([^"\']+)']
    tried = [final_url, *[F.regexp_extract(html, p, 1) for p in patterns]]
    good = [F.when(urls.looks_like_article(c, blocked), c) for c in tried]
    every = F.regexp_extract_all(html, F.lit(r'https?://[^\s"\'<>]+'), F.lit(0))
    return F.coalesce(*good, F.get(F.filter(every, lambda u: urls.looks_like_article(u, blocked)), F.lit(0)))


def resolve(articles: DataFrame, landed: DataFrame, blocked: list[str], budget: int) -> DataFrame:
    """Articles with their redirects followed (HT10): the first ``budget`` that need it; of several that lead to
    one address only the first takes it; followed articles get a new id. ``landed`` has url, final_url, html."""
    host = urls.domain_of(F.col("url"))
    needs = host.isin(blocked) if blocked else F.lit(False)
    first = articles.filter(needs).orderBy("article_id").limit(budget).select("article_id", "url")
    found = first.join(landed.withColumn("target", destination(F.col("html"), F.col("final_url"), blocked)).select("url", "target"), "url").filter("target is not null")
    own = found.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("article_id"))).filter("n = 1").select("article_id", "target")
    out = articles.join(own, "article_id", "left").withColumn("url", F.coalesce("target", "url"))
    new_id = text.stable_id(urls.domain_of(F.col("target")), text.normalize_title(F.col("title")), separator="|")
    return out.withColumns({"previous_id": F.when(F.col("target").isNotNull(), F.col("article_id")), "article_id": F.coalesce(F.when(F.col("target").isNotNull(), new_id), "article_id")}).drop("target")


def describe(pages: DataFrame, markers: list[str]) -> DataFrame:
    """What an unresolved page looks like: bytes, links and which markers it has (HT11)."""
    low = F.lower(F.coalesce("html", F.lit("")))
    seen = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in markers]))
    return pages.select("url", F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"), F.regexp_count(low, F.lit("<a ")).alias("links"), F.array_join(seen, ",").alias("markers"))
