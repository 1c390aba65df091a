"""Metric events, gauges, span trees, outcome roll-ups and the step-count buckets they report in."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.plans.ordered import prefix, total_order, with_halo
from episodica.plans.folds import threshold_resets
from episodica.schema import AGENT
from pyspark.sql import Window

TRAINER = ["behavior_id"]


# --- trainer clock ---------------------------------------------------------------------------


def with_trainer_step(traj: DataFrame, keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Steps a trainer has processed once it has taken in each trajectory, in order of arrival."""
    return prefix(traj, keys or TRAINER, "arrival", {"trainer_step": F.col("length")}, width=width)


def summary_step(traj: DataFrame, freq: int, keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """The report a trajectory's events belong to: the next multiple of `freq`, if it was reached."""
    stepped = prefix(
        traj,
        keys or TRAINER,
        "arrival",
        {"trainer_step": F.col("length")},
        width=width,
        totals={"_reached": F.col("length")},
    )
    label = (F.floor(F.col("trainer_step") / F.lit(freq)) + 1) * F.lit(freq)
    return (
        stepped.withColumn("summary_step", label.cast("long"))
        .filter(F.col("summary_step") <= F.col("_reached"))
        .drop("_reached")
    )


def checkpoint_steps(
    traj: DataFrame, interval: int, keys: list[str] | None = None, width: int | None = None
) -> DataFrame:
    """Steps at which a checkpoint is due: before the trajectory that crosses a multiple, never at 0."""
    before = F.col("trainer_step") - F.col("length")
    crossed = F.floor(F.col("trainer_step") / F.lit(interval)) > F.floor(before / F.lit(interval))
    return (
        with_trainer_step(traj, keys, width)
        .filter(crossed & (before > 0))
        .withColumn("checkpoint_step", before.cast("long"))
    )


def even_interval(max_steps: int, keep: int) -> int:
    return int(max_steps / keep)


def update_rounds(traj: DataFrame, size: int, keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Which on-policy update consumes each trajectory: the buffer is flushed once it exceeds `size`."""
    return threshold_resets(traj, keys or TRAINER, "arrival", "length", size, width)


def updates_due(
    traj: DataFrame,
    init_steps: int,
    steps_per_update: float,
    batch: int,
    keys: list[str] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Off-policy readiness after each trajectory and the number of updates performed by then."""
    ready = (F.col("trainer_step") >= init_steps) & (F.col("trainer_step") >= batch)
    owed = F.ceil((F.col("trainer_step") - init_steps) / F.lit(float(steps_per_update))).cast("long")
    return with_trainer_step(traj, keys, width).select(
        "*",
        ready.alias("ready"),
        F.when(ready, F.greatest(owed, F.lit(1)) - 1).otherwise(F.lit(0)).cast("long").alias("updates_done"),
    )


# --- metric events ---------------------------------------------------------------------------


def environment_events(events: DataFrame) -> DataFrame:
    """A MOST_RECENT statistic is one value, not one per worker: only worker 0 reports it."""
    return events.filter((F.col("method") != "MOST_RECENT") | (F.col("worker_id") == 0))


def summarise_stats(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per (category, key, bucket): moments plus the value its aggregation method asks for.

    The method in force is the last one written for the key. All aggregates are partial.
    """
    keys = keys or ["category", "key", "summary_step"]
    last_value = F.max_by("value", "seq")
    out = events.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.count("value").alias("num"),
        F.sum("value").alias("sum"),
        last_value.alias("last_value"),
        F.max_by("method", "seq").alias("method"),
    )
    value = (
        F.when(F.col("method") == "SUM", F.col("sum"))
        .when(F.col("method") == "MOST_RECENT", F.col("last_value"))
        .otherwise(F.col("mean"))
    )
    return out.withColumn("aggregated_value", value)


def stat_histogram(events: DataFrame, low: float, high: float, bins: int, keys: list[str] | None = None) -> DataFrame:
    """Exact counts over fixed edges; bucket 0 and bins+1 hold what lies outside."""
    keys = keys or ["category", "key"]
    bucket = F.width_bucket(F.col("value"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return events.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def gauges(events: DataFrame) -> DataFrame:
    """Last value, min, max and count per gauge; NaN readings are ignored."""
    clean = events.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return clean.groupBy("name").agg(
        F.max_by("value", "seq").alias("value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.count("value").alias("count"),
        F.max("seq").alias("seq"),
    )


def merge_gauges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Gauges of two processes; the later reading stays."""
    return (
        a.unionByName(b)
        .groupBy("name")
        .agg(
            F.max_by("value", "seq").alias("value"),
            F.min("min_value").alias("min_value"),
            F.max("max_value").alias("max_value"),
            F.sum("count").alias("count"),
            F.max("seq").alias("seq"),
        )
    )


def span_totals(spans: DataFrame) -> DataFrame:
    return spans.groupBy("path").agg(
        F.sum("total").alias("total"),
        F.sum("count").alias("count"),
        F.max(F.col("is_parallel").cast("int")).cast("boolean").alias("is_parallel"),
    )


def merge_spans(a: DataFrame, b: DataFrame, root: str | None = None) -> DataFrame:
    """Add tree b to tree a, optionally below `root`; a tree hung under a root is a parallel one."""
    if root is not None:
        b = b.withColumn("path", F.concat(F.array(F.lit(root)), F.col("path"))).withColumn(
            "is_parallel", F.lit(True)
        )
    cols = ["path", "total", "count", "is_parallel"]
    return span_totals(a.select(*cols).unionByName(b.select(*cols)))


def span_self_time(spans: DataFrame) -> DataFrame:
    """A node's own time: its total less its children's, never below zero."""
    parent = F.slice(F.col("path"), F.lit(1), F.size("path") - 1)
    children = (
        spans.filter(F.size("path") > 1)
        .groupBy(parent.alias("path"))
        .agg(F.sum("total").alias("children_total"))
    )
    return spans.join(children, "path", "left").withColumn(
        "self_time", F.greatest(F.lit(0.0), F.col("total") - F.coalesce("children_total", F.lit(0.0)))
    )


def stats_rollup(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Totals by metric-name prefix: whole log, first name part, full name."""
    part = F.split_part(F.col(key), F.lit("/"), F.lit(1))
    return (
        df.withColumn("part", part)
        .rollup("part", key)
        .agg(F.sum(value).alias("total"), F.count(value).alias("num"), F.grouping_id().alias("level"))
    )


def outcome_rollup(log: DataFrame) -> DataFrame:
    """Episode outcomes by mode and reason, with subtotals; rates are per 1000 steps."""
    return log.rollup("mode", "reason").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("episodes"),
        F.sum("total_steps").alias("steps"),
        F.avg("reward").alias("mean_reward"),
        (F.sum("reaches") * 1000.0 / F.sum("total_steps")).alias("reaches_per_1000"),
    )


def export_metrics(stats: DataFrame, keys: list[str], value: str = "aggregated_value") -> DataFrame:
    """Wide form: one row per step, one column per (given) key."""
    return stats.groupBy("step").pivot("key", keys).agg(F.first(value))


def policy_stats(exp: DataFrame, keys: list[str], by: list[str], cols: dict[str, str]) -> DataFrame:
    """Mean of per-trajectory means, as a trajectory contributes one value whatever its length."""
    per = exp.groupBy(*keys, *[c for c in by if c not in keys]).agg(
        *[F.avg(c).alias(f"_{a}") for a, c in cols.items()]
    )
    return per.groupBy(*by).agg(*[F.avg(f"_{a}").alias(a) for a in cols])


def policy_mean_reward(episodes: DataFrame, by: str = "round") -> DataFrame:
    return episodes.groupBy("behavior_id", by).agg(F.avg("episode_return").alias("mean_reward"))


def running_average(df: DataFrame, keys: list[str], position: str, value: str, width: int | None = None) -> DataFrame:
    """Mean of everything reported so far, per key."""
    out = prefix(df, keys, position, {"_s": F.col(value), "_n": F.lit(1)}, width=width)
    return out.withColumn("running_average", F.col("_s") / F.col("_n")).drop("_s", "_n")


def reward_gate(episodes: DataFrame, n: int, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Pass when the mean of the last n returns is above the threshold and none is NaN.

    The rank filter is a group limit: each task keeps at most n rows per key before the shuffle.
    """
    keys = keys or TRAINER
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in total_order(episodes, keys, "end_tick")])
    return (
        episodes.withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= n)
        .groupBy(*keys)
        .agg(
            F.avg("episode_return").alias("mean_last"),
            F.max(F.isnan("episode_return").cast("int")).alias("_nan"),
        )
        .withColumn("passed", (F.col("_nan") == 0) & (F.col("mean_last") > threshold))
        .drop("_nan")
    )


def adaptive_clip(norms: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """Gradient-norm limit: 2.0 for the first ten readings, then min(5, mean + 2 std of the last 100).

    Input: keys, dense 0-based `rank`, `norm`.
    """
    spread, part = with_halo(norms, keys, "rank", 99, width)
    w = Window.partitionBy(*part).orderBy("rank").rowsBetween(-99, 0)
    limit = F.least(F.lit(5.0), F.avg("norm").over(w) + 2.0 * F.stddev_pop("norm").over(w))
    return (
        spread.withColumn("clip_limit", F.when(F.col("rank") < 10, F.lit(2.0)).otherwise(limit))
        .filter(~F.col("_halo"))
        .select(*norms.columns, "clip_limit")
    )


def episode_rates(steps: DataFrame, event: Column) -> DataFrame:
    """Offset of an episode's first event and its rate per 1000 steps."""
    return steps.groupBy(*AGENT, "episode").agg(
        F.min(F.when(event, F.col("i"))).alias("first_step"),
        F.count(F.lit(1)).alias("total_steps"),
        (F.sum(F.when(event, 1).otherwise(0)) * 1000.0 / F.count(F.lit(1))).alias("rate_per_1000"),
    )


# --- checkpoints -----------------------------------------------------------------------------


def keep_checkpoints(checkpoints: DataFrame, n: int, keys: list[str] | None = None, order: str = "creation_time") -> DataFrame:
    """The newest n checkpoints per behaviour; n <= 0 keeps all. A group limit runs before the shuffle."""
    if n <= 0:
        return checkpoints
    keys = keys or ["behavior"]
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col("steps").desc())
    return checkpoints.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def expired_checkpoints(checkpoints: DataFrame, n: int, keys: list[str] | None = None, id_col: str = "file_path", order: str = "creation_time") -> DataFrame:
    own = [*(keys or ["behavior"]), id_col]
    return checkpoints.join(keep_checkpoints(checkpoints, n, keys, order).select(*own), own, "left_anti")


def latest_policy(policies: DataFrame, keys: list[str] | None = None, version: str = "version") -> DataFrame:
    """Drain the queue, keep the last: one row per behaviour."""
    keys = keys or TRAINER
    rest = [c for c in policies.columns if c not in keys]
    return (
        policies.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_p")).select(*keys, "_p.*")
    )


def seen(df: DataFrame, by: list[str], what: str, approximate: float | None = None) -> DataFrame:
    """How many different values of `what`, and how many rows, each group has.

    Exact counts go through one row for each value, so that no group gathers its values in one task; with a relative
    error allowed, a sketch of fixed size does."""
    if approximate:
        return df.groupBy(*by).agg(F.approx_count_distinct(what, approximate).alias("n_seen"), F.count(F.lit(1)).alias("n_rows"))
    each = df.groupBy(*by, what).agg(F.count(F.lit(1)).alias("_n"))
    return each.groupBy(*by).agg(F.count(what).alias("n_seen"), F.sum("_n").alias("n_rows"))


# Writers by name, as plug-ins register them.
STAT_WRITERS: dict[str, Callable[[DataFrame], None]] = {}


def write_stats(df: DataFrame, writers: dict[str, Callable[[DataFrame], None]] | None = None, hidden: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Give every writer each summary, less the keys it hides; a broken writer does not stop the rest.

    Without a list of its own a call goes to every registered writer."""
    df, writers = df.persist(), STAT_WRITERS if writers is None else writers
    outcome = {}
    try:
        for name, writer in writers.items():
            drop = (hidden or {}).get(name, [])
            try:
                writer(df.filter(~F.col("key").isin(drop)) if drop else df)
                outcome[name] = "ok"
            except Exception as e:  # reported to the caller, by writer
                outcome[name] = f"failed: {e}"
    finally:
        df.unpersist()
    return outcome
