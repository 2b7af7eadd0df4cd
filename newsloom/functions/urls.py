"""URL expressions (NM3-NM5, NM8, HT3, HT8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that only track.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid fbclid mc_cid mc_eid ref referrer sourceid cmpid ncid __source oc ito at_medium".split()
# Query keys under which redirects keep their target.
REDIRECT_KEYS = ["url", "u", "q", "target"]


def parts(url: Column) -> dict[str, Column]:
    """Scheme, host with port, path and query of a URL, each empty if absent."""
    take = lambda group: F.coalesce(F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?", group), F.lit(""))
    return {"scheme": F.lower(take(1)), "netloc": take(2), "path": take(3), "query": take(4)}


def domain_of(url: Column) -> Column:
    """Host in lower case without ``www.`` and port (NM3)."""
    return F.substring_index(F.regexp_replace(F.lower(parts(url)["netloc"]), r"^www\.", ""), ":", 1)


def site_root(url: Column) -> Column:
    """Scheme and host (HT3); null without either."""
    p = parts(url)
    return F.when((p["scheme"] != "") & (p["netloc"] != ""), F.concat(p["scheme"], F.lit("://"), p["netloc"]))


def _pairs(query: Column) -> Column:
    """Key and value of each part of a query string that has a value."""
    pairs = F.transform(F.split(query, "&"), lambda kv: F.struct(F.substring_index(kv, "=", 1).alias("k"), F.when(F.contains(kv, F.lit("=")), F.regexp_replace(kv, "^[^=]*=", "")).otherwise("").alias("v")))
    return F.filter(pairs, lambda p: (p["v"] != ""))


def unwrap(url: Column) -> Column:
    """The target of a redirect kept in a query key (NM4), else the URL."""
    pairs = _pairs(parts(url)["query"])

    def target(key: str) -> Column:
        return F.try_url_decode(F.get(F.filter(pairs, lambda p: p["k"] == key), F.lit(0))["v"])

    decoded = [target(key) for key in REDIRECT_KEYS]
    return F.coalesce(*[F.when(d.startswith("http"), d) for d in decoded], url)


def token_target(url: Column) -> Column:
    """The address inside a base64 article token of an aggregator's path (NM4); null if none."""
    token = F.regexp_extract(parts(url)["path"], r"/articles/([^/]+)$", 1)
    padded = F.rpad(F.translate(token, "-_", "+/"), (F.ceil(F.length(token) / 4) * 4).cast("int"), F.lit("="))
    raw = F.decode(F.try_to_binary(padded, F.lit("base64")), "ISO-8859-1")
    found = F.regexp_extract(raw, r"https?://[\w\-./?%&=:+#@~,;!$'()*\[\]]+", 0)
    return F.when(F.length(found) > 12, found)


def canonical_url(url: Column) -> Column:
    """Unwrapped, without tracking keys, fragment and trailing slash; keys sorted, first values (NM5)."""
    target = unwrap(F.trim(F.coalesce(url, F.lit(""))))
    p = parts(target)
    pairs = F.filter(_pairs(p["query"]), lambda x: ~F.lower(x["k"]).isin(TRACKING))
    keys = F.array_sort(F.array_distinct(F.transform(pairs, lambda x: x["k"])))
    query = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.get(F.filter(pairs, lambda x: x["k"] == k), F.lit(0))["v"])), "&")
    path = F.regexp_replace(p["path"], "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    whole = F.concat(p["scheme"], F.lit("://"), F.lower(p["netloc"]), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(p["scheme"] == "", target).otherwise(whole)


def suffixes(domain: Column) -> Column:
    """A domain and its parents, longest first, without the last label alone (NM8)."""
    labels = F.split(domain, r"\.")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(domain == "", F.array().cast("array<string>")).otherwise(many)


def looks_like_article(url: Column, blocked: list[str], assets: list[str] = ["jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "css", "js", "woff", "woff2", "mp4", "json", "xml"]) -> Column:
    """A page worth following (HT8): http, host not blocked, no asset, a path of 8 characters or more."""
    p, host = parts(url), domain_of(url)
    bad_host = F.lit(False)
    for b in blocked:
        bad_host = bad_host | (host == b) | host.endswith("." + b)
    asset = F.regexp_like(F.lower(p["path"]), F.lit(rf"\.(?:{'|'.join(assets)})$"))
    sized = F.regexp_like(F.coalesce(url, F.lit("")), F.lit(r"=[swh]\d+(?:-|$)"))
    return p["scheme"].isin("http", "https") & ~bad_host & ~asset & ~sized & (F.length(F.regexp_replace(p["path"], "^/+|/+$", "")) >= 8)
