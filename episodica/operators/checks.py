"""Validation against specs, registries and configurations."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions import vectors as V
from episodica.functions.numbers import finite
from episodica.plans.lineage import join_stats


# --- values ----------------------------------------------------------------------------------


def _all_finite(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    if kind.startswith("array<array"):
        return ~F.exists(c, lambda inner: F.exists(inner, lambda x: ~finite(x)))
    if kind.startswith("array"):
        return ~F.exists(c, lambda x: ~finite(x))
    return finite(c)


def finite_flag(df: DataFrame, cols: list[str]) -> Column:
    """True where every element of every column is a finite number (a missing column value passes)."""
    out = F.lit(True)
    for c in cols:
        out = out & F.coalesce(_all_finite(df, c) | F.col(c).isNull(), F.lit(False))
    return out


def assert_finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """Stop the job at the first row with NaN or infinity."""
    ok = finite_flag(df, cols)
    message = F.concat(F.lit("non-finite value in "), F.lit(", ".join(cols)))
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def quarantine_nonfinite(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    ok = finite_flag(df, cols)
    return df.filter(ok), df.filter(~ok)


# --- specs -----------------------------------------------------------------------------------


def check_shapes(df: DataFrame, specs: DataFrame, obs: str = "obs") -> DataFrame:
    """Rows with `shape_ok`: as many observations as the spec names, each as long as its shape's product."""
    want = F.transform(
        F.col("observations"), lambda o: F.aggregate(o["shape"], F.lit(1), lambda a, n: a * n)
    )
    have = F.transform(F.col(obs), lambda o: F.size(o))
    return (
        join_stats(df, specs.select("behavior_id", want.alias("_want")), ["behavior_id"], "left")
        .withColumn("shape_ok", F.coalesce(have == F.col("_want"), F.lit(False)))
        .drop("_want")
    )


def check_actions(df: DataFrame, specs: DataFrame, action: str = "action", mask: str | None = "action_mask") -> DataFrame:
    """Rows with `action_problem`: null, or the first thing wrong with the action or its mask."""
    spec = specs.select("behavior_id", "continuous_size", "discrete_branches")
    a = F.col(action)
    in_range = F.forall(
        F.zip_with(a["discrete"], F.col("discrete_branches"), lambda x, n: (x >= 0) & (x < n)), lambda ok: ok
    )
    problem = (
        F.when(F.col("continuous_size").isNull(), "unknown behavior")
        .when(F.size(a["continuous"]) != F.col("continuous_size"), "continuous size")
        .when(F.size(a["discrete"]) != F.size("discrete_branches"), "discrete size")
        .when(~in_range, "action out of range")
    )
    if mask:
        m = F.col(mask)
        problem = problem.when(
            m.isNotNull() & (F.size(m) > F.size("discrete_branches")), "unknown branch"
        ).when(m.isNotNull() & F.exists(m, lambda b: (F.size(b) > 0) & F.forall(b, lambda x: x)), "all actions masked")
    return (
        join_stats(df, spec, ["behavior_id"], "left")
        .withColumn("action_problem", problem)
        .drop("continuous_size", "discrete_branches")
    )


def spec_mismatch(demo: DataFrame, policy: DataFrame) -> DataFrame:
    """Differences between recorded and expected specs, per behaviour."""
    shapes = F.transform("observations", lambda o: o["shape"])
    cols = ["behavior_id", "continuous_size", "discrete_branches"]
    d = demo.select(*cols, shapes.alias("shapes"))
    p = policy.select(*cols, shapes.alias("shapes"))
    j = d.alias("d").join(p.alias("p"), "behavior_id", "fullouter")
    return j.select(
        "behavior_id",
        F.col("d.shapes").isNull().alias("missing_demo"),
        F.col("p.shapes").isNull().alias("missing_policy"),
        (
            ~(
                F.col("d.continuous_size").eqNullSafe(F.col("p.continuous_size"))
                & F.col("d.discrete_branches").eqNullSafe(F.col("p.discrete_branches"))
            )
        ).alias("action_differs"),
        (~F.size("d.shapes").eqNullSafe(F.size("p.shapes"))).alias("observation_count_differs"),
        (~F.col("d.shapes").eqNullSafe(F.col("p.shapes"))).alias("observation_shapes_differ"),
    )


def fill_missing_actions(df: DataFrame, specs: DataFrame, action: str = "action") -> DataFrame:
    """Agents that were given no action act with zeros of the spec's sizes."""
    zeros = F.struct(
        F.array_repeat(F.lit(0.0).cast("float"), F.col("continuous_size")).alias("continuous"),
        F.array_repeat(F.lit(0), F.size("discrete_branches")).alias("discrete"),
    )
    spec = specs.select("behavior_id", "continuous_size", "discrete_branches")
    return (
        join_stats(df, spec, ["behavior_id"], "left")
        .withColumn(action, F.coalesce(F.col(action), zeros))
        .drop("continuous_size", "discrete_branches")
    )


# --- registries ------------------------------------------------------------------------------


def known_behaviors(df: DataFrame, registry: DataFrame, key: str = "behavior_id") -> tuple[DataFrame, DataFrame]:
    """Rows someone handles, and rows nobody does."""
    known = registry.select(key).distinct()
    return join_stats(df, known, [key], "left_semi"), join_stats(df, known, [key], "left_anti")


def new_behaviors(df: DataFrame, registry: DataFrame, key: str = "behavior_id") -> DataFrame:
    return df.select(key).distinct().join(registry.select(key), key, "left_anti")


def all_behaviors(df: DataFrame, registry: DataFrame, key: str = "behavior_id") -> DataFrame:
    return df.select(key).union(registry.select(key)).distinct()


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


# --- branched actions ------------------------------------------------------------------------


def action_lookup(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """Every combination of branch choices with its scalar code; its size is fixed by the action space."""
    count = 1
    for n in sizes:
        count *= n
    codes = spark.range(count).withColumnRenamed("id", "action_code")
    parts = V.unpack_action("action_code", sizes)
    return codes.select("action_code", *[parts[i].alias(f"a{i}") for i in range(len(sizes))])


def flatten_actions(df: DataFrame, lookup: DataFrame, branches: list[str]) -> DataFrame:
    return df.join(lookup, branches)


# --- ragged columns --------------------------------------------------------------------------


def pad_to_widest(df: DataFrame, col: str, fill, keys: list[str] | None = None) -> DataFrame:
    """Fill ragged lists to the widest list of the whole frame (or of each key)."""
    if keys:
        widest = df.groupBy(*keys).agg(F.max(F.size(col)).alias("_w"))
        joined = df.join(widest, keys)
    else:
        one = df.agg(F.max(F.size(col)).alias("_w"))
        joined = df.withColumn("_w", one.scalar())
    return joined.withColumn("padded", V.pad_list(col, F.col("_w"), fill)).drop("_w")


# --- run configurations ----------------------------------------------------------------------


def overlay_config(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every key of either side; the override wins. Columns: behavior, key_path, value."""
    o = overrides.withColumnRenamed("value", "_o")
    return defaults.join(o, ["behavior", "key_path"], "fullouter").select(
        "behavior", "key_path", F.coalesce("_o", "value").alias("value")
    )


def config_features(config: DataFrame) -> DataFrame:
    """Which optional parts each behaviour's configuration switches on, and its main sizes."""

    def has(part: str) -> Column:
        hit = (F.col("key_path") == part) | F.col("key_path").startswith(part + ".")
        return F.coalesce(F.max((hit & F.col("value").isNotNull()).cast("int")), F.lit(0)).cast("boolean")

    def value_of(path: str) -> Column:
        return F.max(F.when(F.col("key_path") == path, F.col("value")))

    signals = ("extrinsic", "curiosity", "gail", "rnd")
    return config.groupBy("run_id", "behavior").agg(
        value_of("trainer_type").alias("trainer_type"),
        *[has(f"reward_signals.{s}").alias(f"{s}_enabled") for s in signals],
        has("behavioral_cloning").alias("cloning_enabled"),
        has("network_settings.memory").alias("recurrent_enabled"),
        has("self_play").alias("self_play_enabled"),
        value_of("network_settings.hidden_units").alias("hidden_units"),
        value_of("network_settings.num_layers").alias("num_layers"),
    )


def with_parameters(episodes: DataFrame, parameters: DataFrame) -> DataFrame:
    """Sampled environment parameters beside the episodes they were active in."""
    return episodes.join(parameters, ["param", "lesson"])
