"""The given tables in the roles that the jobs need, as frames and as SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import text
from newsloom.operators.sizing import spread

# The type of source that each of the 20 sources stands for.
TYPES = ["exchange_filing", "regulator", "company_ir", "wire", "financial_press", "financial_press", "financial_press", "financial_press", "newspaper", "newspaper", "newspaper", "newspaper", "trade_publication", "trade_publication", "trade_publication", "trade_publication", "unknown", "unknown", "blog", "social"]
TICKERS = [f"T{i:02d}" for i in range(11)]
# Words of the corpus that stand for keywords, names and terms.
CATEGORY_WORDS = {"ORDER_WIN": ["attion", "thanea"], "EARNINGS": ["erou", "onin the"], "REGULATORY": ["thing", "anth"], "TARIFF": ["ersh", "erti"], "COMMODITY": ["anti", "onre"], "FRAUD": ["retion", "hein"], "TENDER": ["reing", "inan"], "TECHNOLOGY": ["onor", "anre"]}
COOCCUR = [("MERGER", ["only", "onth"], ["ones", "here"]), ("CAPEX", ["thea", "anin"], ["rein", "reth"]), ("TARIFF", ["ered"], ["erat"])]
MARKERS = {
    "speculative": ["onhe", "thwh"], "opinion": ["aned", "erer"], "listing_page": ["onti"], "official_language": ["onnd", "thsh"], "routine_release": ["thea"], "market_chatter": ["anin", "reth"],
    "recruitment": ["erti"], "research_report": ["onor", "hein"], "legal_notice": ["onin", "the thing"],
}
NAMES = ["thanea", "anti", "erou the", "onth", "anre", "ersh", "reing of", "thwh", "onin", "erti", "hein"]
TERMS = [("COMPETITOR", "Anon"), ("CUSTOMER", "Erer"), ("SUPPLIER", "onhe"), ("COMMODITY", "onre"), ("REGULATION", "thsh"), ("INDUSTRY", "ered"), ("INDUSTRY", "of the"), ("GEOGRAPHY", "thea"), ("GEOGRAPHY", "anin"), ("PRODUCT", "inan"), ("TECHNOLOGY", "retion"), ("MACRO", "onor")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def articles(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents as articles: the first line is the title, and the summary is as long as normalisation leaves it.
    ``more`` are columns to keep as they are."""
    docs = table(spark, sf_dir, "documents")
    number = F.substring("source", 4, 9).cast("int")
    return docs.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("article_id"), "doc_id",
        F.trim(F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 120)).alias("title"), F.substring("text", 1, 1200).alias("summary"),
        F.concat("source", F.lit(".example.com")).alias("source_domain"), F.concat(F.lit("https://"), "source", F.lit(".example.com/a/"), (F.col("doc_id") % 700).cast("string")).alias("url"),
        F.timestamp_add("MINUTE", (37 * F.col("doc_id")).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("published"),
        F.get(F.array(*[F.lit(t) for t in TYPES]), number).alias("source_type"), (number < 2).alias("is_official"), F.get(F.array(*[F.lit(t) for t in TICKERS]), (F.col("doc_id") % 11).cast("int")).alias("ticker"), *more,
    )


_TYPES_SQL = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
#: The same as a common table expression ``a``.
ARTICLES = f"""a AS (
    SELECT lpad(doc_id::VARCHAR, 12, '0') AS article_id, doc_id, trim(substr(split_part(text, chr(10), 1), 1, 120)) AS title, substr(text, 1, 1200) AS summary, text AS body,
           source || '.example.com' AS source_domain, 'https://' || source || '.example.com/a/' || (doc_id % 700) AS url, TIMESTAMP '2024-01-01' + to_minutes(37 * doc_id) AS published,
           ({_TYPES_SQL})[substr(source, 4)::INTEGER + 1] AS source_type, substr(source, 4)::INTEGER < 2 AS is_official, 'T' || lpad((doc_id % 11)::VARCHAR, 2, '0') AS ticker
    FROM documents)"""


def fold_sql(x: str) -> str:
    out = f"lower(strip_accents(coalesce({x}, '')))"
    for entity, plain in (("&amp;", "&"), ("&#39;", "''"), ("&quot;", '"')):
        out = f"replace({out}, '{entity}', '{plain}')"
    out = f"translate({out}, '’‘–—', '''''--')"
    return f"trim(regexp_replace(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}_\\s%/&.+-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def words_sql(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def canonical_sql(folded: str) -> str:
    """Canonical words of a folded text, with the packaged lists."""
    for phrase, plain in text.MULTIWORD:
        folded = f"regexp_replace({folded}, '(^|[^a-z0-9]){phrase}($|[^a-z0-9])', '\\1{plain}\\2', 'g')"
    table_ = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.SYNONYMS.items()) + "}"
    first = f"[coalesce({table_}[t], t) for t in string_split({folded}, ' ') if t <> '' and t not in {words_sql([*text.STOPWORDS, *text.FILLER])}]"
    return f"[t for t in {first} if t not in {words_sql(text.FILLER)} and length(t) > 2]"


def ratio_sql(pairs: str) -> str:
    """Common table expressions that end in ``ratios`` (id, ratio): the sequence ratio of texts ``a`` and ``b`` of each row of
    ``pairs``, which has an ``id`` of its own. Each step takes the longest run of equal characters of a stretch, the earliest in a, then
    in b, and goes on with the stretches before and after it. To be used after WITH RECURSIVE; for texts below 200 characters."""
    return f"""rp AS MATERIALIZED ({pairs}),
    rm AS MATERIALIZED (SELECT id, i, j FROM (SELECT id, a, b, unnest(range(length(a))) AS i FROM rp) x, LATERAL (SELECT unnest(range(length(b))) AS j) y
        WHERE substr(a, i::INTEGER + 1, 1) = substr(b, j::INTEGER + 1, 1)),
    rs AS (SELECT id, 0::BIGINT AS a0, length(a)::BIGINT AS a1, 0::BIGINT AS b0, length(b)::BIGINT AS b1, 0::BIGINT AS k FROM rp
        UNION ALL
        SELECT id, CASE WHEN half = 0 THEN a0 ELSE i + n END, CASE WHEN half = 0 THEN i ELSE a1 END, CASE WHEN half = 0 THEN b0 ELSE j + n END, CASE WHEN half = 0 THEN j ELSE b1 END,
               CASE WHEN half = 0 THEN n ELSE 0 END
        FROM (SELECT * FROM (SELECT id, a0, a1, b0, b1, min(i) AS i, min(j) AS j, count(*) AS n FROM (
                  SELECT rs.*, rm.i, rm.j, rm.i - row_number() OVER (PARTITION BY rs.id, a0, a1, b0, b1, rm.i - rm.j ORDER BY rm.i) AS run
                  FROM rs JOIN rm ON rs.id = rm.id AND rm.i >= a0 AND rm.i < a1 AND rm.j >= b0 AND rm.j < b1)
              GROUP BY id, a0, a1, b0, b1, i - j, run)
              QUALIFY row_number() OVER (PARTITION BY id, a0, a1, b0, b1 ORDER BY n DESC, i, j) = 1), (VALUES (0), (1)) h(half)),
    ratios AS (SELECT id, CASE WHEN any_value(length(a) + length(b)) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * sum(k) / any_value(length(a) + length(b)) END AS ratio
        FROM rp JOIN rs USING (id) GROUP BY id)"""


def likeness_sql(common: str, one: str, other: str, ratio: str) -> str:
    """Title similarity from the numbers of common words and of each title's words, and the sequence ratio. Rounded by its
    decimal form, a half up, as Spark's ``round`` does."""
    jaccard = f"CASE WHEN {common} = 0 THEN 0 ELSE {common} / ({one} + {other} - {common}) END"
    contained = f"CASE WHEN {common} = 0 THEN 0 ELSE {common} / least({one}, {other}) END"
    return decimal_round_sql(f"greatest(0.5::DOUBLE * ({jaccard}) + 0.3::DOUBLE * {ratio} + 0.2::DOUBLE * ({contained}), 0.8::DOUBLE * ({contained}))")


def decimal_round_sql(x: str, places: int = 4) -> str:
    """A double between 0 and 10 rounded by its decimal form."""
    return f"round((({x})::VARCHAR)::DECIMAL(38, 20), {places})::DOUBLE"


def has_sql(folded: str, phrases: list[str]) -> str:
    """Does a folded text contain one of some phrases?"""
    return f"regexp_matches({folded}, '{text.pattern_of(phrases, lookaround=False)}')"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with folded title and whole text."""
    rows = articles(spark, sf_dir, "text")
    return rows.withColumns({"head_f": text.fold(F.col("title")), "text_f": text.fold(F.concat_ws(" ", "title", "text"))}).drop("text")


TEXTS = f"""{ARTICLES}, t AS (SELECT *, {fold_sql('title')} AS head_f, {fold_sql("title || ' ' || body")} AS text_f FROM a)"""


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small dimension of fixed rows, sent as an Arrow table: as a list, it would start a Python worker for each core."""
    kinds = T.StructType.fromDDL(schema)
    return spark.createDataFrame(pa.table({n: pa.array([r[k] for r in rows]) for k, n in enumerate(kinds.names)}), kinds)


def values_sql(rows: list[tuple]) -> str:
    def one(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


DIRECTIONS = {"view": "POSITIVE", "signup": "NEGATIVE", "click": "MIXED", "error": "UNCERTAIN", "purchase": "NEUTRAL"}
RELATIONS = ["WEAK", "MACRO", "SECTOR", "INDIRECT", "INDIRECT_STRONG", "DIRECT"]
THEMES = ["COMMODITY:steel", "INDUSTRY:solar", None, "COMMODITY:coal", None, "INDUSTRY:ports"]


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored pairs of event and company: three rows make an event."""
    e = table(spark, sf_dir, "events")
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))
    directions = F.create_map(*[F.lit(x) for p in DIRECTIONS.items() for x in p])
    group = F.floor(F.col("event_id") / 3)
    return e.select(
        F.format_string("E%07d", group).alias("event_id"), pick(TICKERS, F.col("user_id") % 11).alias("ticker"), F.least(F.lit(15), F.floor(F.col("value") / 10)).cast("int").alias("impact_score"),
        ((F.col("event_id") * 37) % 90 / 100 + 0.05).alias("confidence"), F.element_at(directions, F.col("event_type")).alias("direction"), pick(RELATIONS, F.col("event_id") % 6).alias("relationship"),
        (group % 4 == 0).alias("is_international"), (group % 5 == 0).alias("has_official"), pick(THEMES, F.col("user_id") % 6).alias("theme"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type"),
        F.array(F.concat(F.lit("watch "), F.col("event_type")), F.concat(F.lit("watch "), (F.col("user_id") % 7).cast("string"))).alias("watch_next"), F.col("event_id").alias("row_id"), (F.col("user_id") % 5).cast("int").alias("n_exposures"),
    )


PAIRS = f"""p AS (
    SELECT 'E' || lpad((event_id // 3)::VARCHAR, 7, '0') AS event_id, 'T' || lpad((user_id % 11)::VARCHAR, 2, '0') AS ticker, least(15, floor(value / 10))::INTEGER AS impact_score,
           (event_id * 37) % 90 / 100.0::DOUBLE + 0.05::DOUBLE AS confidence, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in DIRECTIONS.items())} END AS direction,
           ({'[' + ', '.join(f"'{r}'" for r in RELATIONS) + ']'})[event_id % 6 + 1] AS relationship, (event_id // 3) % 4 = 0 AS is_international, (event_id // 3) % 5 = 0 AS has_official,
           ({'[' + ', '.join('NULL' if r is None else f"'{r}'" for r in THEMES) + ']'})[user_id % 6 + 1] AS theme, ts, event_type, event_id AS row_id, (user_id % 5)::INTEGER AS n_exposures,
           ['watch ' || event_type, 'watch ' || (user_id % 7)] AS watch_next
    FROM events),
    ok AS (SELECT * FROM p WHERE impact_score >= CASE WHEN relationship = 'WEAK' THEN 9 ELSE 5 END)"""
