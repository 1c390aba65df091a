"""Replay buffers: retention, sampling, shuffling, mini-batches, normalisation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.numbers import as_col, mixed_uniform, spread_key, spread_uniform, text_key
from episodica.plans.lineage import join_stats
from episodica.plans.ordered import prefix

BUFFER = ["behavior_id"]


def with_rank(df: DataFrame, position: str, keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """0-based position of a row in its buffer, and the buffer's size `n_rows`."""
    keys = keys or BUFFER
    one = F.lit(1)
    return prefix(df, keys, position, {"rank": one}, inclusive=False, width=width, totals={"n_rows": one})


def newest(df: DataFrame, position: str, cap: Column | int, keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """The newest `cap` rows per key; cap may be an expression over `n_rows`, the key's row count."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    ranked = with_rank(df, position, keys, width)
    return ranked.filter(F.col("rank") >= F.col("n_rows") - cap).select(*df.columns)


def truncate_replay(df: DataFrame, size: int, length: int, position: str = "tick", keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Above `size` rows, keep the newest 80%, rounded down to whole sequences."""
    keep = int(0.8 * size)
    keep -= keep % length
    return newest(df, position, F.when(F.col("n_rows") > size, F.lit(keep)).otherwise(F.col("n_rows")), keys, width)


def last_sequences(df: DataFrame, n: int, length: int, position: str = "tick", keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    return newest(df, position, n * length, keys, width)


def shuffle_sequences(ranked: DataFrame, length: int, seed: int, keys: list[str] | None = None) -> DataFrame:
    """A new order of whole sequences; the tail shorter than a sequence is left out.

    Adds `shuffled`, the row's place in the new order. One row per sequence is ranked by a hash of its
    number; its rows follow by an equi-join.
    """
    keys = keys or BUFFER
    seqs = ranked.withColumn("_seq", F.floor(F.col("rank") / length).cast("long"))
    whole = F.col("_seq") < F.floor(F.col("n_rows") / length)
    heads = seqs.filter((F.col("rank") % length == 0) & whole).select(*keys, "_seq")
    placed = _rank_within(heads, keys, spread_key("_seq", seed), "_seq", "_place")
    return seqs.join(placed, [*keys, "_seq"]).select(
        *ranked.columns, (F.col("_place") * length + F.col("rank") % length).alias("shuffled")
    )


def _rank_within(df: DataFrame, keys: list[str], key: Column, tie: str, alias: str) -> DataFrame:
    """0-based rank by a 0..2^32-1 key, then by `tie`, per `keys`, over equal slices of the key's range."""
    return prefix(
        df.withColumn("_k", key), keys, "_k", {alias: F.lit(1)}, ["_k", tie], inclusive=False, width=1 << 20
    ).drop("_k")


def minibatches(shuffled: DataFrame, batch: int, length: int) -> DataFrame:
    """Cut a shuffled buffer into full batches of whole sequences; the rest is left out."""
    size = max(batch - batch % length, length)
    rows = F.floor(F.col("n_rows") / length) * length
    return shuffled.withColumn("batch_no", F.floor(F.col("shuffled") / size).cast("long")).filter(
        F.col("batch_no") < F.floor(rows / size)
    )


def sample_draws(rows: DataFrame, batch: int, length: int, seed: int, keys: list[str] | None = None, u: Column | None = None) -> DataFrame:
    """batch//length sequence numbers per buffer, uniform with replacement. Columns: keys, draw, seq_no. Rows are only counted: they need no rank."""
    keys = keys or BUFFER
    n = max(batch // length, 1)
    sizes = rows.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) / length).cast("long").alias("_seqs"))
    draws = sizes.filter("_seqs > 0").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = spread_uniform(F.lit(seed), text_key(*keys), "draw") if u is None else u
    return draws.withColumn("seq_no", F.floor(u * F.col("_seqs")).cast("long")).drop("_seqs")


def gather_sequences(ranked: DataFrame, draws: DataFrame, length: int, keys: list[str] | None = None) -> DataFrame:
    """Rows of the drawn sequences; a sequence drawn twice comes twice."""
    keys = keys or BUFFER
    rows = ranked.withColumn("seq_no", F.floor(F.col("rank") / length).cast("long"))
    return rows.join(draws, [*keys, "seq_no"])


def sample_replay(rows: DataFrame, position: str, batch: int, length: int, seed: int, keys: list[str] | None = None) -> DataFrame:
    """Sequences drawn from each buffer; the buffers are ranked once, for the rows that are gathered."""
    return gather_sequences(with_rank(rows, position, keys), sample_draws(rows, batch, length, seed, keys), length, keys)


def partitioned(df: DataFrame, col: str, n: int) -> DataFrame:
    """The rows of codes 0..n-1 as one frame: group or write by the code, in one scan."""
    return df.filter(F.col(col).between(0, n - 1))


def dynamic_partition(df: DataFrame, col: str, n: int) -> list[DataFrame]:
    """One frame per integer code 0..n-1."""
    return [df.filter(F.col(col) == i) for i in range(n)]


def pair_expert(policy: DataFrame, demos: DataFrame, seed: int, keys: list[str], u: Column | None = None) -> DataFrame:
    """An expert row (drawn with replacement) beside each policy row, in equal number.

    Both sides have a dense `rank` per key; the draw depends on seed and policy rank only.
    """
    sizes = demos.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    u = mixed_uniform(F.lit(seed), *keys, "rank") if u is None else u
    drawn = join_stats(policy, sizes, keys).withColumn("_pick", F.floor(u * F.col("_n")).cast("long")).drop("_n")
    expert = demos.select(
        *keys, F.col("rank").alias("_pick"), *[F.col(c).alias(f"expert_{c}") for c in demos.columns if c not in keys]
    )
    return drawn.join(expert, [*keys, "_pick"]).drop("_pick")


# --- normalisation ---------------------------------------------------------------------------


def fit_normalizer(df: DataFrame, obs: str, dim: int, keys: list[str] | None = None) -> DataFrame:
    """Running mean and M2 of an observation, from a prior of one step with mean 0 and M2 1.

    The recurrence has an order-free closed form, so it is one partial aggregate and no sort.
    """
    keys = keys or BUFFER
    x = [f"double(get({obs}, {i}))" for i in range(dim)]
    each = lambda form: "array(" + ", ".join(form.format(x=c, i=i) for i, c in enumerate(x)) + ")"
    sums = df.groupBy(*keys).agg(
        (F.count(F.lit(1)) + 1).alias("steps"),
        F.expr(each("sum({x})")).alias("_s"),
        F.expr(each("sum({x} * {x})")).alias("_q"),
    )
    return sums.select(
        *keys,
        "steps",
        F.expr("transform(_s, s -> s / steps)").alias("mean"),
        F.expr("zip_with(_q, _s, (q, s) -> 1D + q - s * s / steps)").alias("m2"),
    )


def apply_normalizer(df: DataFrame, stats: DataFrame, obs: str, keys: list[str] | None = None) -> DataFrame:
    """clip((x - mean) / sqrt(M2 / steps), -5, 5)."""
    keys = keys or BUFFER
    scaled = F.zip_with(
        F.zip_with(F.col(obs), F.col("mean"), lambda x, m: x.cast("double") - m),
        F.col("m2"),
        lambda d, m2: F.greatest(F.least(d / F.sqrt(m2 / F.col("steps")), F.lit(5.0)), F.lit(-5.0)),
    )
    return join_stats(df, stats, keys).withColumn("normalized", scaled).drop("steps", "mean", "m2")


def normalise_advantages(df: DataFrame, by: list[str], advantage: str = "advantage") -> DataFrame:
    """Zero mean, unit (population) deviation over each update batch."""
    stats = df.groupBy(*by).agg(F.avg(advantage).alias("_m"), F.stddev_pop(advantage).alias("_sd"))
    return (
        join_stats(df, stats, by)
        .withColumn("normal_advantage", (F.col(advantage) - F.col("_m")) / (F.col("_sd") + F.lit(1e-10)))
        .drop("_m", "_sd")
    )


def masked_mean(value, mask) -> Column:
    """Aggregate: sum of the unmasked values over their number (at least one)."""
    value, mask = as_col(value), as_col(mask)
    return F.sum(F.when(mask, value).otherwise(0.0)) / F.greatest(
        F.sum(F.when(mask, 1.0).otherwise(0.0)), F.lit(1.0)
    )
