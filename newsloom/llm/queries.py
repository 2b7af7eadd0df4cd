"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import bpe, chat, filter_audit, jaccard_join, lexical_search, packing, page_text, pii, quality, secrets, simhash, topk, url_rules
from newsloom.llm.support import stored, table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = page_text.extract(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The rules that the query applies (host, path, action).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, action string"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_neighbours(stored(simhash.with_edits(table(spark, sf_dir, "documents"))))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


#: A conversation whose texts are made of control strings.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(rows))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.scan(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "pipeline": corpus_pipeline.run,
    "op2_main_text": op2_main_text,
    "op10_secret_scan": op10_secret_scan,
    "op3_url_rules": op3_url_rules,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_exact_topk": op7_exact_topk,
    "op9_chat_format": op9_chat_format,
    "op8_pack_sequences": op8_pack_sequences,
    "op11_lexical_search": op11_lexical_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_personal_data": op13_personal_data,
}

ORACLES: dict[str, str] = {
    "op3_url_rules": """
        WITH u AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        r(rule_host, rule_path, verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        n AS (SELECT *, row_number() OVER () AS i FROM u),
        m AS (SELECT n.i, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
              FROM n JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n.i)
        SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM n LEFT JOIN m USING (i)""",
    "op4_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS ws FROM documents),
        t AS (SELECT min(doc_id) AS id, ws, count(*) AS n_copies FROM w GROUP BY ws),
        g AS (SELECT id, unnest(list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                     ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END)) AS gram FROM t WHERE len(ws) > 0),
        z AS (SELECT id, count(*) AS n FROM g GROUP BY id),
        i AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY 1, 2),
        l AS (SELECT a, b FROM i JOIN z za ON za.id = a JOIN z zb ON zb.id = b WHERE c * 5 >= 4 * (za.n + zb.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT id, id AS root FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
        k AS (SELECT id, min(root) AS class_id FROM r GROUP BY id),
        d AS (SELECT a AS id, count(*) AS n_links FROM e GROUP BY a)
        SELECT w.doc_id, t.id AS copy_id, k.class_id, coalesce(d.n_links, 0) AS n_links, t.n_copies
        FROM w JOIN t ON w.ws = t.ws JOIN k ON k.id = t.id LEFT JOIN d ON d.id = t.id""",
    "op7_exact_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS i, vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.i, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.i <> c.i AND len(q.e) = len(c.e)),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_chat_format": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, x.turn, x.role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
        p AS (SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(24 + length(role) + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')))::BIGINT AS formatted_chars,
               bool_and(CASE role WHEN 'system' THEN before = '' WHEN 'user' THEN before IN ('', 'system', 'assistant', 'tool')
                        WHEN 'assistant' THEN before IN ('user', 'tool') WHEN 'tool' THEN before = 'assistant' ELSE false END) AS valid
        FROM p GROUP BY conv_id""",
    "op11_lexical_search": """
        WITH d AS (
            SELECT row_number() OVER () AS i, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws
            FROM documents),
        q AS (
            SELECT row_number() OVER () AS j, item_id,
                   list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS ws
            FROM benchmark),
        z AS (SELECT count(*) AS n, sum(len(ws)) AS l FROM d WHERE len(ws) > 0),
        m AS (SELECT i, doc_id, 100 - 50 + ((50 * len(ws) * z.n) // z.l)::BIGINT AS m FROM d, z WHERE len(ws) > 0),
        t AS (SELECT i, w, count(*) AS tf FROM (SELECT i, unnest(ws) AS w FROM d) GROUP BY i, w),
        k AS (SELECT w, floor(1000 * ln((2 * z.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, z GROUP BY w, z.n),
        s AS (
            SELECT j, item_id, i, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
            FROM (SELECT j, item_id, unnest(ws) AS w FROM q) JOIN k USING (w) JOIN t USING (w) JOIN m USING (i) GROUP BY ALL),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50""",
    "op12_filter_audit": """
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        f AS (
            SELECT doc_id, part,
                   (len(ws) < 100)::INTEGER + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INTEGER
                   + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INTEGER + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER
                   + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INTEGER AS fails
            FROM d),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        c AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
        o(filter_order) AS (
            SELECT '' UNION ALL SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE length(filter_order) < 5 AND NOT contains(filter_order, x)),
        s AS (
            SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
                   list_sum([1 << (ascii(filter_order[k]) - 65) for k in range(1, step)])::INTEGER AS earlier
            FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
        x AS (
            SELECT part, filter_order, step, own,
                   sum(n) FILTER ((fails & (coalesce(earlier, 0) | own)) = 0) AS kept,
                   sum(n) FILTER ((fails & coalesce(earlier, 0)) = 0 AND (fails & own) > 0) AS removed,
                   sum(n) FILTER ((fails & coalesce(earlier, 0)) > 0 AND (fails & own) > 0) AS redundant,
                   sum(n) FILTER (fails = own) AS unique_fails,
                   sum(good) FILTER ((fails & coalesce(earlier, 0)) = 0 AND (fails & own) > 0) AS good_lost,
                   sum(toxic) FILTER ((fails & coalesce(earlier, 0)) = 0 AND (fails & own) > 0) AS toxic_lost
            FROM c, s GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
               coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
               coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
        FROM x""",
}
