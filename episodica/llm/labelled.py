"""Labelled rows for the classifiers: folds by a checksum of the id, and a bounded sample of the learning fold."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def learning_sample(labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """(id, label) of at most `per_class` labelled documents of each class, those of the smallest hashes.

    Null ids and labels are left out; of contradicting labels of a document the higher counts."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
    one = one.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    parts = [one.filter(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def with_text(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, label) of the sampled documents; the sample is of a fixed size, so it goes to every task."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id")
