"""Operator 3 [native]: URL filters by host-suffix and path-prefix expressions.

Each URL is expanded into expressions of a host suffix and a path prefix that ends in a slash. Only
the shapes (labels, slashes) that some rule has are expanded, so a long URL makes no more
expressions than there are shapes. Expressions meet the rules in an equi-join on a short prefix of
their SHA-256; the full digest and the rest of the rule's path are then confirmed, and the longest
rule wins (at equal length, block before allow).

Defined results: a null URL, or one without ``://``, has an empty host and path and meets no rule;
an empty path starts with no rule that has a path; URLs without a rule get the method's verdict,
``allow``; repeated rows and repeated ids are judged each; an empty rule table allows all; columns
other than the id and the URL are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT_DIGITS = 8
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def _folder(path: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def rule_table(rules: DataFrame) -> DataFrame:
    """(rule, action, rule_host, rule_path, labels, slashes, digest) of (host, path, action)."""
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    return rules.select("action", host.alias("rule_host"), path.alias("rule_path")).select(
        F.concat("rule_host", "rule_path").alias("rule"),
        "action",
        "rule_path",
        _labels(F.col("rule_host")).alias("labels"),
        _slashes(F.col("rule_path")).alias("slashes"),
        F.sha2(F.concat("rule_host", F.lit("\n"), _folder(F.col("rule_path"))), 256).alias("rule_digest"),
    )


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``; ``rules`` has host, path, action."""
    table = rule_table(rules)
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    # the shapes of all rules: as few as there are pairs of small numbers
    shapes = [(r["labels"], r["slashes"]) for r in table.select("labels", "slashes").distinct().collect()]
    if not shapes:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, slashes = F.split("host", r"\.", -1), F.split("path", "/", -1)

    def expression(n_labels: int, n_slashes: int) -> Column:
        suffix = F.array_join(F.slice(labels, -n_labels, n_labels), ".")
        folder = F.concat(F.array_join(F.slice(slashes, 1, n_slashes), "/"), F.lit("/")) if n_slashes else F.lit("")
        fits = (F.size(labels) >= n_labels) & (F.size(slashes) > n_slashes)
        return F.when(fits, F.concat(suffix, F.lit("\n"), folder))

    expanded = rows.withColumn("expression", F.explode_outer(F.array_compact(F.array(*[expression(a, b) for a, b in sorted(shapes)]))))
    expanded = expanded.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT_DIGITS))
    table = table.withColumn("short", F.substring("rule_digest", 1, SHORT_DIGITS)).drop("labels", "slashes")
    met = expanded.join(table, "short", "left")
    fits = (F.col("digest") == F.col("rule_digest")) & F.expr("startswith(path, rule_path)")
    won = F.max(F.when(fits, F.struct(F.length("rule").alias("n"), (F.col("action") == "block").alias("block"), F.col("rule"), F.col("action")))).alias("won")
    best = met.groupBy("row", "page_id", "host", "path").agg(won)
    return best.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))
