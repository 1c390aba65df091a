"""Reliable lineage cuts: shared-folder checkpoints only, so a lost executor costs a re-read."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; on one machine a scratch folder where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write once, read many: for inputs that several branches of a plan need."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package wrote, wherever it lies; nothing happens if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# Parts that the rows of one key are dealt to in a join with per-key aggregates.
SALTS = 8


def join_stats(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join per-key aggregates to rows whose key may be hot: one plan for all sizes.

    Rows are dealt to `salts` parts of their key and the aggregates, one row a key, stand ready in each part. Whether
    they are broadcast is the optimizer's choice by their bytes.
    """
    plain = [c for c, t in df.dtypes if not t.startswith("map")]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
