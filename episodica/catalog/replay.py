"""Replay retention, sampling and normalisation."""

from pyspark.sql import functions as F

from episodica.catalog import STEPS_SQL, experiences_sql, query, r, table
from episodica.catalog.sessions import experiences, steps
from episodica.functions.numbers import spread_key, spread_sql, spread_uniform_sql, steady, text_key_sql
from episodica.operators import replay as B
from episodica.operators import returns as R

RANKED_SQL = (
    STEPS_SQL
    + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY behavior_id ORDER BY tick) - 1 AS rank,
  count(*) OVER (PARTITION BY behavior_id) AS n FROM steps)"""
)
SHUFFLED_SQL = (
    RANKED_SQL
    + f""",
heads AS (SELECT behavior_id, rank // 4 AS seq, row_number() OVER (PARTITION BY behavior_id
  ORDER BY {spread_sql('rank // 4', 17)}, rank // 4) - 1 AS place
  FROM ranked WHERE rank % 4 = 0 AND rank // 4 < n // 4),
shuffled AS (SELECT r.*, h.place * 4 + r.rank % 4 AS shuffled FROM ranked r
  JOIN heads h ON h.behavior_id = r.behavior_id AND h.seq = r.rank // 4)"""
)
DRAWS_SQL = (
    RANKED_SQL
    + f""",
draws AS (SELECT behavior_id, d AS draw, CAST(floor({spread_sql('d', 5)}
   / 4294967296.0::DOUBLE * (n // 4)) AS BIGINT) AS seq_no
  FROM (SELECT DISTINCT behavior_id, n FROM ranked), (SELECT unnest(generate_series(0, 15)) AS d))"""
)


def buffer(spark, sf_dir, *extra):
    return steps(spark, sf_dir, "behavior_id", "tick", "k", *extra)


def draw_u(index):
    return spread_key(index, 5) / F.lit(4294967296.0)


@query("replay_truncated", f"""WITH {RANKED_SQL} SELECT behavior_id, tick, k FROM ranked
WHERE n <= 1000 OR rank >= n - (CAST(0.8 * 1000 AS INT) - CAST(0.8 * 1000 AS INT) % 7)""")
def replay_truncated(spark, sf_dir):
    return B.truncate_replay(buffer(spark, sf_dir), 1000, 7)


@query("replay_last_sequences", f"WITH {RANKED_SQL} SELECT behavior_id, tick, k FROM ranked WHERE rank >= n - 60")
def replay_last_sequences(spark, sf_dir):
    return B.last_sequences(buffer(spark, sf_dir), 15, 4)


def _shuffled(spark, sf_dir):
    ranked = B.with_rank(buffer(spark, sf_dir), "tick")
    return B.shuffle_sequences(ranked, 4, 17)


@query("replay_shuffled", f"WITH {SHUFFLED_SQL} SELECT behavior_id, tick, shuffled FROM shuffled")
def replay_shuffled(spark, sf_dir):
    return _shuffled(spark, sf_dir).select("behavior_id", "tick", "shuffled")


@query(
    "replay_minibatches",
    f"""WITH {SHUFFLED_SQL}, c AS (SELECT *, count(*) OVER (PARTITION BY behavior_id) // 32 AS nb FROM shuffled)
SELECT behavior_id, shuffled // 32 AS batch_no, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k FROM c
WHERE shuffled // 32 < nb GROUP BY 1, 2""",
)
def replay_minibatches(spark, sf_dir):
    out = B.minibatches(_shuffled(spark, sf_dir), 34, 4)
    return out.groupBy("behavior_id", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"))


@query(
    "replay_sampled_sequences",
    f"""WITH {DRAWS_SQL} SELECT d.behavior_id, d.draw, r.tick, r.k FROM draws d
JOIN ranked r ON r.behavior_id = d.behavior_id AND r.rank // 4 = d.seq_no""",
)
def replay_sampled_sequences(spark, sf_dir):
    ranked = B.with_rank(buffer(spark, sf_dir), "tick")
    draws = B.sample_draws(buffer(spark, sf_dir), 64, 4, 0, u=draw_u(F.col("draw")))
    out = B.gather_sequences(ranked, draws, 4)
    return out.select("behavior_id", F.col("draw").cast("long").alias("draw"), "tick", "k")


@query(
    "replay_random_sample",
    f"""WITH {RANKED_SQL}, sizes AS (SELECT behavior_id, count(*) // 4 AS n FROM ranked GROUP BY 1),
draws AS (SELECT behavior_id, range AS draw, CAST(floor({spread_uniform_sql('1337', text_key_sql('behavior_id'), 'range')} * n) AS BIGINT) AS seq_no
  FROM sizes, range(16) WHERE n > 0)
SELECT d.behavior_id, d.draw, r.tick, r.k FROM draws d JOIN ranked r ON r.behavior_id = d.behavior_id AND r.rank // 4 = d.seq_no""",
)
def replay_random_sample(spark, sf_dir):
    out = B.sample_replay(buffer(spark, sf_dir), "tick", 64, 4, seed=1337)
    return out.select("behavior_id", F.col("draw").cast("long").alias("draw"), "tick", "k")


@query(
    "rows_partitioned_by_code",
    f"WITH {STEPS_SQL} SELECT action AS code, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_k FROM steps GROUP BY 1",
)
def rows_partitioned_by_code(spark, sf_dir):
    parts = B.partitioned(steps(spark, sf_dir, "action", "k"), "action", 5)
    return parts.groupBy(F.col("action").cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"))


@query(
    "expert_pairs",
    f"""WITH {STEPS_SQL},
p AS (SELECT action, tick, k, row_number() OVER (PARTITION BY action ORDER BY tick) - 1 AS rank
  FROM steps WHERE behavior_id NOT LIKE 'b1%'),
e AS (SELECT action, tick, k, row_number() OVER (PARTITION BY action ORDER BY tick) - 1 AS rank,
  count(*) OVER (PARTITION BY action) AS n FROM steps WHERE behavior_id LIKE 'b1%'),
s AS (SELECT action, max(n) AS n FROM e GROUP BY 1)
SELECT p.action, p.tick, e.tick AS expert_tick, e.k AS expert_k FROM p JOIN s ON s.action = p.action
JOIN e ON e.action = p.action AND e.rank = CAST(floor({spread_sql('p.rank', 5)}
  / 4294967296.0::DOUBLE * s.n) AS BIGINT)""",
)
def expert_pairs(spark, sf_dir):
    st = steps(spark, sf_dir, "behavior_id", "action", "tick", "k")
    expert = F.col("behavior_id").startswith("b1")
    policy, demos = (B.with_rank(st.filter(c).drop("behavior_id"), "tick", ["action"]) for c in (~expert, expert))
    out = B.pair_expert(policy, demos, 0, ["action"], u=draw_u(F.col("rank")))
    return out.select("action", "tick", "expert_tick", "expert_k")


@query(
    "advantages_normalised",
    f"""WITH {experiences_sql(64)}, d AS (SELECT *, reward + 0.99::DOUBLE * v_next - value_est AS a FROM exps)
SELECT agent_id, tick, {r('''(a - avg(a) OVER (PARTITION BY behavior_id))
  / (stddev_pop(a) OVER (PARTITION BY behavior_id) + 1e-10::DOUBLE)''')} AS normal_advantage FROM d""",
)
def advantages_normalised(spark, sf_dir):
    exp = R.bootstrap(experiences(spark, sf_dir, "value_est"))
    out = B.normalise_advantages(R.gae(exp, 0.99, 0.0, 64), ["behavior_id"])
    return out.select("agent_id", "tick", steady("normal_advantage").alias("normal_advantage"))


@query(
    "masked_means",
    f"""WITH {STEPS_SQL} SELECT behavior_id, {r('sum(CASE WHEN is_terminal THEN reward ELSE 0 END) / greatest(sum(CAST(is_terminal AS INT)), 1)')}
AS masked_mean FROM steps GROUP BY 1""",
)
def masked_means(spark, sf_dir):
    st = steps(spark, sf_dir, "behavior_id", "reward", "is_terminal")
    out = st.groupBy("behavior_id").agg(B.masked_mean("reward", "is_terminal").alias("m"))
    return out.select("behavior_id", steady("m").alias("masked_mean"))


DIMS_SQL = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT vec_id, label, unnest(v) AS x, unnest(generate_series(0, 63)) AS dim FROM e),
st AS (SELECT label, dim, count(*) + 1 AS steps, sum(x) / (count(*) + 1) AS mean,
  1 + sum(x * x) - sum(x) * sum(x) / (count(*) + 1) AS m2 FROM x GROUP BY 1, 2)"""


@query(
    "observation_normaliser",
    f"WITH {DIMS_SQL} SELECT label, CAST(dim AS INT) AS dim, steps, {r('mean', 6)} AS mean, {r('m2', 6)} AS m2 FROM st",
)
def observation_normaliser(spark, sf_dir):
    stats = B.fit_normalizer(table(spark, sf_dir, "embeddings"), "embedding", 64, ["label"])
    return stats.select("label", "steps", F.posexplode(F.arrays_zip("mean", "m2")).alias("dim", "s")).select(
        "label", "dim", "steps", steady(F.col("s.mean"), 6).alias("mean"), steady(F.col("s.m2"), 6).alias("m2")
    )


@query(
    "observations_normalised",
    f"""WITH {DIMS_SQL} SELECT vec_id, {r('sum(n)')} AS total, {r('max(n)')} AS top FROM (
SELECT x.vec_id, greatest(least((x - mean) / sqrt(m2 / steps), 5.0::DOUBLE), -5.0::DOUBLE) AS n
FROM x JOIN st ON st.label = x.label AND st.dim = x.dim) GROUP BY 1""",
)
def observations_normalised(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    out = B.apply_normalizer(emb, B.fit_normalizer(emb, "embedding", 64, ["label"]), "embedding", ["label"])
    n = F.col("normalized")
    return out.select(
        "vec_id", steady(F.aggregate(n, F.lit(0.0), lambda a, x: a + x)).alias("total"),
        steady(F.array_max(n)).alias("top"),
    )
