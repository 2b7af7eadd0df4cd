"""A corpus pipeline of four operators over the documents: each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import jaccard_join, packing, quality, secrets
from newsloom.llm.support import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limit of their language. Null and empty texts and documents that cannot be judged
    stay; repeated rows are judged alike and stay or go together; columns stay as they are; an empty table gives no rows."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8 or more), the one of the smallest id. Equal texts and repeated rows are
    one group, texts without words as well; rows without an id stay; columns stay as they are; an empty table gives no rows."""
    return jaccard_join.first_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark, overlapping ones by one; ``n_chars`` follows. Texts without secrets and null
    texts stay as they are, repeated rows are changed alike; columns stay as they are; an empty table gives no rows."""
    return secrets.redact(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. A null text is an empty one, which has its end mark alone; repeated rows are packed each; columns
    beside id and text are not read; an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack_tokens),
]

#: Perplexities and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
