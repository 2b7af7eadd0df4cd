"""Operator 10 [native]: secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hexadecimal strings) are reported where they
stand. Weak candidates, which alone mean little, are endpoints and long mixed strings.
Each weak candidate is reported only if a complementary part stands within its scope: parts are
intervals, dealt by document and by the stretches of ``SCOPE`` code points of their ends, and joined where
they are at most ``SCOPE`` apart. An access identifier or an endpoint
complements a mixed string; a mixed string or an assignment complements an endpoint. Positions are in
code points, ends exclusive. Only documents with some part take part in the join.

Defined results: null text counts as empty; a text without parts has no spans; equal spans found
twice count once; repeated rows get the same spans each; texts of any length are read whole; null
ids are an id like others; other columns pass by unread, or are kept by ``redact`` under any name; an
empty table gives no rows. An endpoint is a host of at most nine names before its service's (a longer
one is reported from the ninth), of the services listed below; a mixed string is a whole run of 32 or more
letters, digits, plus signs and slashes with upper case, lower case and a digit. Positions are found by
running sums in stretches of ``STRETCH`` items, so that work grows with a text's matches, not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.support import scratch_names

# The patterns of the strong kinds, in the order in which spans at one place are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 or more in all: the same matches as of AKIA[A-Z0-9]+ cut to those
HEX = r"[0-9a-f]{24,}"
# Weak kinds: a host of a service, and a whole run of 32 characters or more of mixed case with digits.
SERVICE = r"(?i)\.(?:amazonaws|azure|googleapis|windows)\.(?:com|net)"
ENDPOINT = r"(?i)(?:https?://)?[a-z0-9-]{1,63}(?:\.[a-z0-9-]{1,63}){0,8}\.(?:amazonaws|azure|googleapis|windows)\.(?:com|net)"
MIXED = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])(?=[A-Z0-9+/]*+[a-z])(?=[a-z0-9+/]*+[A-Z])[A-Za-z0-9+/]{32,}+"
KINDS = ["assign", "access", "hex", "endpoint", "mixed"]
#: Which kinds make a weak kind credible.
COMPLEMENTS = [("mixed", "access"), ("mixed", "endpoint"), ("endpoint", "access"), ("endpoint", "mixed"), ("endpoint", "assign")]
SCOPE = 400
STRETCH = 256
SPAN = "struct<start:int,rank:int,end:int>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stretches(items: Column) -> Column:
    """An array cut into arrays of at most STRETCH items; none for an empty one."""
    count = F.ceil(F.size(items) / STRETCH).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: F.slice(items, k * STRETCH + 1, STRETCH)), lambda part: F.size(part) > 0)


def running(numbers: Column, add, first: int = 0) -> Column:
    """The running results of an associative ``add`` over an array of int: within each stretch, then over
    the stretches' totals."""
    none = F.array().cast("array<int>")

    def scan(part: Column) -> Column:
        start = F.struct(F.lit(first).alias("at"), none.alias("done"))

        def step(s: Column, x: Column) -> Column:
            return F.struct(add(s["at"], x).alias("at"), F.concat(s["done"], F.array(add(s["at"], x))).alias("done"))

        return F.aggregate(part, start, step, lambda s: s["done"])

    def whole(parts: Column) -> Column:
        bases = F.concat(F.array(F.lit(first)), scan(F.transform(parts, lambda p: F.element_at(p, -1))))
        return F.flatten(F.zip_with(parts, F.slice(bases, F.lit(1), F.size(parts)), lambda p, b: F.transform(p, lambda x: add(b, x))))

    return let(F.transform(stretches(numbers), scan), whole)


def found(text: Column, pattern: str, kind: str, keep: Column | None = None, hint: str = "") -> Column:
    """Spans of the leftmost matches that don't overlap. The texts between matches and the matches
    alternate, so running sums of their lengths are the places. ``hint`` is a pattern that is faster
    to look for and stands in every match."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    steps = F.zip_with(gaps, sizes, lambda g, m: F.struct((g + F.coalesce(m, F.lit(0))).alias("step"), F.coalesce(m, F.lit(0)).alias("size")))

    def placed(both: Column) -> Column:
        ends = let(F.transform(both, lambda x: x["step"]), lambda n: running(n, lambda a, b: a + b))
        span = lambda x, end: F.struct((end - x["size"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"))
        return F.zip_with(both, ends, span)

    spans = F.filter(let(steps, placed), lambda s: s["end"] > s["start"])
    if keep is not None:
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("s"), keep.alias("k")), lambda z: z["k"]), lambda z: z["s"])
    return F.when(F.regexp_like(text, F.lit(hint or pattern)), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _assignments(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return found(text, ASSIGN, "assign", F.transform(values, lambda v: F.length(v) >= 6))


def _written(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def _key(df: DataFrame) -> DataFrame:
    """A key that equal documents share: the id and a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("body"), F.xxhash64(text).alias("text_hash"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, strong): strong spans of every row."""
    body = F.col("body")
    strong = F.concat(_assignments(body), found(body, ACCESS, "access"), found(body, HEX, "hex"))
    return _key(docs).select("doc_id", "text_hash", strong.alias("strong"))


def linked_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, linked): weak spans with a complementary part within scope; only
    documents that have some, once each."""
    body = F.col("body")
    weak = F.concat(found(body, ENDPOINT, "endpoint", hint=SERVICE), found(body, MIXED, "mixed"))
    rows = _key(docs).select("doc_id", "text_hash", "body", weak.alias("weak")).filter(F.size("weak") > 0)
    every = F.concat("weak", _assignments(body), found(body, ACCESS, "access"))
    parts = rows.select("doc_id", "text_hash", F.explode(every).alias("part")).select("doc_id", "text_hash", "part.*").distinct()
    pairs = F.array(*[F.struct(F.lit(KINDS.index(a)).alias("weak_rank"), F.lit(KINDS.index(b)).alias("rank")) for a, b in COMPLEMENTS])
    # a part that doesn't overlap a weak part ends within reach before it or starts within reach after it, so
    # a part lies in the stretches of its start and its end, and the weak part looks around its own ends
    around = lambda low, high: F.sequence(F.floor(low / scope), F.floor(high / scope))
    before, after = around(F.col("weak_start") - scope, F.col("weak_start")), around(F.col("weak_end"), F.col("weak_end") + scope)
    weak_parts = (
        parts.withColumnsRenamed({"start": "weak_start", "end": "weak_end", "rank": "weak_rank"})
        .filter(F.col("weak_rank").isin(*{KINDS.index(a) for a, _ in COMPLEMENTS}))
        .withColumn("stretch", F.explode(F.array_union(before, after)))
    )
    reach = parts.withColumn("stretch", F.explode(F.array_distinct(F.array(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope)))))
    near = (F.col("start") <= F.col("weak_end") + scope) & (F.col("end") >= F.col("weak_start") - scope)
    apart = (F.col("end") <= F.col("weak_start")) | (F.col("start") >= F.col("weak_end"))
    fits = F.array_contains(pairs, F.struct("weak_rank", "rank"))
    same = [weak_parts["doc_id"].eqNullSafe(reach["doc_id"]), weak_parts["text_hash"] == reach["text_hash"], weak_parts["stretch"] == reach["stretch"]]
    met = weak_parts.join(reach, [*same, near, apart, fits], "left_semi")
    span = F.struct(F.col("weak_start").alias("start"), F.col("weak_rank").alias("rank"), F.col("weak_end").alias("end"))
    return met.groupBy("doc_id", "text_hash").agg(F.collect_set(span).alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, strong, linked) for every row."""
    base, more = base_spans(docs).alias("b"), linked_spans(docs, scope).alias("m")
    on = [F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")), F.col("b.text_hash") == F.col("m.text_hash")]
    none = F.array().cast(f"array<{SPAN}>")
    return base.join(more, on, "left").select("b.doc_id", "b.text_hash", "strong", F.coalesce("linked", none).alias("linked"))


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and digests of each document's spans."""
    count = lambda kind: F.size(F.filter("strong", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_written(F.col("strong")), 256).alias("base_sha256"),
        _written(F.concat("strong", "linked")).alias("spans"),
    )


def _masked(body: Column, spans: Column, mark: str) -> Column:
    """The text with each span replaced by ``mark``, overlapping spans by one. A span that begins at or after
    all ends before it opens a mark; the text before it begins at the largest of those ends."""
    ends = lambda s: let(F.transform(s, lambda x: x["end"]), lambda n: running(n, F.greatest))

    def cut(s: Column, reached: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), reached)
        pairs = F.zip_with(s, F.slice(before, F.lit(1), F.size(s)), lambda x, low: F.struct(low.alias("low"), x["start"].alias("high")))
        gaps = F.concat(F.filter(pairs, lambda g: g["high"] >= g["low"]), F.array(F.struct(F.element_at(reached, -1).alias("low"), F.length(body).alias("high"))))
        # the text of a stretch is cut out first, as finding a place in a text takes longer the further on it is
        parts = let(gaps, lambda g: F.transform(stretches(g), piece))
        return F.array_join(F.flatten(parts), mark)

    def piece(part: Column) -> Column:
        low = F.get(part, F.lit(0))["low"]
        own = F.substring(body, low + 1, F.element_at(part, -1)["high"] - low)
        return let(own, lambda t: F.transform(part, lambda g: F.substring(t, g["low"] - low + 1, g["high"] - g["low"])))

    return let(spans, lambda s: let(ends(s), lambda reached: cut(s, reached)))


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """The documents with every span replaced by ``mark`` (overlapping spans by one); ``n_chars``, if
    there, follows the new text. The columns stay as they were, whatever their names, and so do texts without spans."""
    row, found_id, text_hash, linked, body = scratch_names(docs, "row", "found_id", "text_hash", "linked", "body")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias(row), F.col("doc_id").cast("long").alias(found_id), text.alias(body), F.xxhash64(text).alias(text_hash)).alias("b")
    more = linked_spans(docs, scope).alias("m")
    on = [F.col(f"b.{found_id}").eqNullSafe(F.col("m.doc_id")), F.col(f"b.{text_hash}") == F.col("m.text_hash")]
    whole = F.col(body)
    strong = F.concat(_assignments(whole), found(whole, ACCESS, "access"), found(whole, HEX, "hex"))
    spans = F.array_sort(F.concat(strong, F.coalesce(F.col("m.linked"), F.array().cast(f"array<{SPAN}>"))))
    masked = rows.join(more, on, "left").select(row, body, spans.alias(linked)).withColumn(text_hash, F.when(F.size(linked) > 0, _masked(F.col(body), F.col(linked), mark)))
    changed = F.col(text_hash).isNotNull()
    new = F.col(row).withField("text", F.when(changed, F.col(text_hash)).otherwise(F.col(row)["text"].cast("string")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new = new.withField("n_chars", F.when(changed, F.length(text_hash).cast(kind)).otherwise(F.col(row)["n_chars"]))
    return masked.select(new.alias(row)).select(f"{row}.*")
