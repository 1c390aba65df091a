"""A corpus from documents to token ids: five stages, each a DataFrame from the one before.

Quality classifier, near copies, personal data, curriculum mix, tokens. Every stage but the last returns the columns of
documents; repeated rows after the mix are copies that the mix takes more than once.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import bpe, jaccard, mixing, pii, quality
from episodica.llm.common import cut, documents, fresh_name, table
from episodica.llm.labelled import fold
from episodica.llm.queries import RANKS


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier scores 0.5 or more; it learns from two folds of three."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    score = fresh_name(docs, "score")
    return quality.scored(docs, model, score).filter(F.col(score) >= 0.5).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return jaccard.without_near_copies(docs)


def private_data_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and revealing terms in the texts."""
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target, in the order of the curriculum."""
    return mixing.mixed(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the digest of what they decode to."""
    checked = bpe.encode_and_check(spark, F.col("text"), public_tokenizers.path(RANKS))
    rows = docs.select("doc_id", "lang", "source", checked.alias("_t"))
    n_tokens = F.size("_t.ids").cast("long").alias("n_tokens")
    return rows.select("doc_id", "lang", "source", n_tokens, "_t.ids", "_t.decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("near_copies", one_of_each),
    ("private_data", private_data_replaced),
    ("mix", mixed_sources),
    ("tokens", token_ids),
]

# Learned scores, hashed sketches and merges are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
