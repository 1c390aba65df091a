"""Streaming summaries, late rows, and a bounded replay store."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.operators.replay import truncate_replay
from episodica.plans.lineage import discard
from episodica.operators.stats import environment_events, summarise_stats
from episodica.sources.logs import split_methods


def stream_stats(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Running summary per (category, key, step bucket); for update or complete mode."""
    return summarise_stats(environment_events(events), keys)


def windowed_stats(events: DataFrame, window: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Summary per event-time window; a window is final once the watermark has passed it."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        events.withWatermark("ts", delay)
        .groupBy(span.alias("window"), "category", "key")
        .agg(F.count("value").alias("num"), F.avg("value").alias("mean"), F.sum("value").alias("sum"))
    )


def dedup_late(steps: DataFrame, delay: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Drop repeated rows that arrive within the delay of each other."""
    keys = keys or ["behavior_id", "worker_id", "agent_id", "tick", "is_terminal"]
    return steps.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def silent_sessions(steps: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Bursts of activity per agent: a gap closes an episode whose end was lost."""
    return (
        steps.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("session"), "behavior_id", "worker_id", "agent_id")
        .agg(F.count(F.lit(1)).alias("n_steps"), F.max("tick").alias("last_tick"))
    )


def env_stats_writer(path: str):
    """foreachBatch handler: one summary per micro-batch, then the slate is clean (idempotent by batch)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        out = summarise_stats(environment_events(batch), ["category", "key"])
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle


def replay_writer(path: str, size: int, length: int, every: int = 10, position: str = "tick"):
    """foreachBatch handler: append each batch; every n batches compact to the newest rows.

    A generation is written under its own folder and a repeated batch overwrites its own output, so
    a restart leaves no duplicates. Readers take the newest generation; the one before it stays for those that
    are reading, older ones are deleted once a newer one stands.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        generation = batch_id // every
        if batch_id % every == 0 and batch_id > 0:
            spark = batch.sparkSession
            old = load_stream_replay(spark, path, generation - 1)
            merged = truncate_replay(old.unionByName(batch), size, length, position)
            merged.write.mode("overwrite").parquet(f"{path}/generation={generation}/batch={batch_id}")
            discard(spark, f"{path}/generation={generation - 2}")
        else:
            batch.write.mode("overwrite").parquet(f"{path}/generation={generation}/batch={batch_id}")

    return handle


def load_stream_replay(spark: SparkSession, path: str, generation: int | None = None) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(f"{path}/generation=*")
    newest = F.lit(generation) if generation is not None else rows.agg(F.max("generation")).scalar()
    return rows.filter(F.col("generation") == newest).drop("generation", "batch")


def known_and_unknown(good: str, bad: str):
    """foreachBatch handler: metric events of known methods into one table, the others into another (a repeated batch overwrites its own rows)."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        for rows, path in zip(split_methods(batch), (good, bad)):
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return handle
