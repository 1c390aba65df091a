"""Validation, registries, configurations, extension points."""

import numpy as np
from pyspark.sql import functions as F

from episodica.catalog import STEPS_SQL, experiences_sql, query, r, table
from episodica.catalog.columns import EMB_SQL, embeddings
from episodica.catalog.sessions import experiences, steps
from episodica.functions import sql as named
from episodica.functions.numbers import steady
from episodica.operators import checks as K
from episodica.operators import plugins as X
from episodica.operators import sessions as S
from episodica.schema import AGENT


def defective(spark, sf_dir):
    """Steps whose signups lack a number: NaN rewards, infinite observations."""
    st = steps(spark, sf_dir, "behavior_id", "tick", "k", "action", "reward")
    inf = F.lit(float("inf"))
    return st.select(
        "behavior_id", "tick",
        F.when(F.col("action") == 2, F.lit(float("nan"))).otherwise(F.col("reward")).alias("reward"),
        F.array(F.col("k").cast("double"), F.when(F.col("k") == 7, inf).otherwise(F.lit(0.0))).alias("obs"),
    )


@query("nonfinite_quarantined", f"WITH {STEPS_SQL} SELECT tick, behavior_id FROM steps WHERE action = 2 OR k = 7")
def nonfinite_quarantined(spark, sf_dir):
    _, bad = K.quarantine_nonfinite(defective(spark, sf_dir), ["reward", "obs"])
    return bad.select("tick", "behavior_id")


@query("finite_asserted", f"WITH {STEPS_SQL} SELECT tick, {r('reward')} AS reward FROM steps")
def finite_asserted(spark, sf_dir):
    st = K.assert_finite(steps(spark, sf_dir, "tick", "reward", "k"), ["reward", "k"])
    return st.select("tick", steady("reward").alias("reward"))


def specs(spark, sf_dir):
    """One spec per behaviour seen, with sizes that follow from its name."""
    b = steps(spark, sf_dir, "behavior_id").distinct()
    n = F.substring("behavior_id", 2, 1).cast("int")
    shape = lambda c: F.array(c.cast("int"), F.lit(2))
    return b.select(
        "behavior_id", F.lit(1).alias("continuous_size"), F.array(F.lit(5), n + 2).alias("discrete_branches"),
        F.array(
            F.struct(F.lit("ray").alias("name"), shape(n + 1).alias("shape")),
            F.struct(F.lit("vec").alias("name"), shape(F.lit(1)).alias("shape")),
        ).alias("observations"),
    )


@query(
    "observation_shapes_checked",
    f"""WITH {STEPS_SQL} SELECT tick, CAST((k % 3 + 1) * 2 = (CAST(substr(behavior_id, 2, 1) AS INT) + 1) * 2 AS INT) AS shape_ok FROM steps""",
)
def observation_shapes_checked(spark, sf_dir):
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    st = steps(spark, sf_dir, "behavior_id", "tick", "k").withColumn(
        "obs", F.array(zeros((F.col("k") % 3 + 1) * 2), zeros(F.lit(2)))
    )
    out = K.check_shapes(st, specs(spark, sf_dir))
    return out.select("tick", F.col("shape_ok").cast("int").alias("shape_ok"))


@query(
    "actions_checked",
    f"""WITH {STEPS_SQL} SELECT tick, CASE WHEN k % 10 = 1 THEN 'continuous size' WHEN k % 10 = 2 THEN 'discrete size'
 WHEN k % 4 >= CAST(substr(behavior_id, 2, 1) AS INT) + 2 THEN 'action out of range'
 WHEN k % 10 = 4 THEN 'unknown branch' WHEN k % 10 = 5 THEN 'all actions masked' ELSE 'ok' END AS problem FROM steps""",
)
def actions_checked(spark, sf_dir):
    k = F.col("k")
    cont = F.when(k % 10 == 1, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0)))
    disc = F.when(k % 10 == 2, F.array("action")).otherwise(F.array(F.col("action"), (k % 4).cast("int")))
    open_ = F.array(F.lit(False), F.lit(True))
    shut = F.array(F.lit(True), F.lit(True))
    mask = F.when(k % 10 == 4, F.array(open_, open_, open_)).when(k % 10 == 5, F.array(open_, shut)).otherwise(F.array(open_, open_))
    st = steps(spark, sf_dir, "behavior_id", "tick", "k", "action").select(
        "behavior_id", "tick", F.struct(cont.alias("continuous"), disc.alias("discrete")).alias("action"), mask.alias("action_mask")
    )
    out = K.check_actions(st, specs(spark, sf_dir))
    return out.select("tick", F.coalesce("action_problem", F.lit("ok")).alias("problem"))


@query(
    "missing_actions_filled",
    f"""WITH {STEPS_SQL} SELECT tick, CASE WHEN is_terminal THEN 0 ELSE action END AS d0, CAST(CASE WHEN is_terminal THEN 0 ELSE 1 END AS INT) AS d1 FROM steps""",
)
def missing_actions_filled(spark, sf_dir):
    st = steps(spark, sf_dir, "behavior_id", "tick", "action", "is_terminal")
    given = F.struct(F.array(F.lit(0.0).cast("float")).alias("continuous"), F.array(F.col("action"), F.lit(1)).alias("discrete"))
    st = st.withColumn("action", F.when(~F.col("is_terminal"), given))
    out = K.fill_missing_actions(st, specs(spark, sf_dir))
    return out.select("tick", F.col("action.discrete")[0].alias("d0"), F.col("action.discrete")[1].alias("d1"))


@query(
    "spec_mismatches",
    f"""WITH {STEPS_SQL}, d AS (SELECT DISTINCT behavior_id AS b FROM steps)
SELECT b AS behavior_id, CAST(b LIKE 'b1%' AS INT) AS missing_policy, CAST(b NOT LIKE 'b0%' AS INT) AS action_differs,
CAST(b LIKE 'b1%' AS INT) AS observation_count_differs, CAST(b LIKE 'b1%' AS INT) AS observation_shapes_differ FROM d""",
)
def spec_mismatches(spark, sf_dir):
    demo = specs(spark, sf_dir)
    n = F.substring("behavior_id", 2, 1)
    policy = demo.filter(n != "1").withColumn(
        "continuous_size", F.when(n == "2", 3).otherwise(F.col("continuous_size"))
    )
    out = K.spec_mismatch(demo, policy)
    names = ["missing_policy", "action_differs", "observation_count_differs", "observation_shapes_differ"]
    return out.select("behavior_id", *[F.col(c).cast("int").alias(c) for c in names])


def registry(spark, sf_dir):
    """Behaviours someone manages: those named by the first nations' keys."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("b"), (n % 5).cast("string"), F.lit("?team=0")).alias("behavior_id")
    ).distinct()


REG_SQL = "reg AS (SELECT DISTINCT 'b' || (n_nationkey % 5) || '?team=0' AS behavior_id FROM nation)"


@query("behaviors_known", f"WITH {STEPS_SQL}, {REG_SQL} SELECT tick FROM steps WHERE behavior_id IN (SELECT behavior_id FROM reg)")
def behaviors_known(spark, sf_dir):
    return K.known_behaviors(steps(spark, sf_dir, "tick", "behavior_id"), registry(spark, sf_dir))[0].select("tick")


@query("behaviors_unknown", f"WITH {STEPS_SQL}, {REG_SQL} SELECT tick FROM steps WHERE behavior_id NOT IN (SELECT behavior_id FROM reg)")
def behaviors_unknown(spark, sf_dir):
    return K.known_behaviors(steps(spark, sf_dir, "tick", "behavior_id"), registry(spark, sf_dir))[1].select("tick")


@query("behaviors_new", f"WITH {STEPS_SQL}, {REG_SQL} SELECT behavior_id FROM steps EXCEPT SELECT behavior_id FROM reg")
def behaviors_new(spark, sf_dir):
    return K.new_behaviors(steps(spark, sf_dir, "behavior_id"), registry(spark, sf_dir))


@query("behaviors_seen_or_registered", f"WITH {STEPS_SQL}, {REG_SQL} SELECT behavior_id FROM steps UNION SELECT behavior_id FROM reg")
def behaviors_seen_or_registered(spark, sf_dir):
    return K.all_behaviors(steps(spark, sf_dir, "behavior_id"), registry(spark, sf_dir))


@query(
    "required_columns",
    f"WITH {experiences_sql(64)} SELECT 'none' AS missing, count(*) AS n FROM exps",
)
def required_columns(spark, sf_dir):
    exp = experiences(spark, sf_dir, "value_est")
    gone = K.missing_columns(exp, ["done", "reward", "interrupted", "value_est", "i"]) or ["none"]
    return exp.agg(F.count(F.lit(1)).alias("n")).select(F.lit(",".join(gone)).alias("missing"), "n")


@query(
    "config_overlay",
    """WITH d AS (SELECT 'part' || (p_partkey % 7) AS behavior, p_name || p_partkey AS key_path, p_brand AS value FROM part),
o AS (SELECT 'part' || (p_partkey % 7) AS behavior, p_name || (p_partkey + (p_partkey % 2) * 1000000) AS key_path, p_type AS value
  FROM part WHERE p_size > 25)
SELECT coalesce(d.behavior, o.behavior) AS behavior, coalesce(d.key_path, o.key_path) AS key_path, coalesce(o.value, d.value) AS value
FROM d FULL JOIN o ON d.behavior = o.behavior AND d.key_path = o.key_path""",
)
def config_overlay(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    b = F.concat(F.lit("part"), (F.col("p_partkey") % 7).cast("string")).alias("behavior")
    key = lambda c: F.concat("p_name", c.cast("string")).alias("key_path")
    d = p.select(b, key(F.col("p_partkey")), F.col("p_brand").alias("value"))
    o = p.filter("p_size > 25").select(
        b, key(F.col("p_partkey") + (F.col("p_partkey") % 2) * 1000000), F.col("p_type").alias("value")
    )
    return K.overlay_config(d, o)


@query(
    "config_feature_flags",
    """SELECT 'r' || (p_partkey % 20) AS run_id, p_brand AS behavior,
CAST(coalesce(max(CASE WHEN p_size % 5 = 1 THEN 1 END), 0) AS INT) AS curiosity_enabled,
CAST(coalesce(max(CASE WHEN p_size % 5 = 2 THEN 1 END), 0) AS INT) AS recurrent_enabled,
CAST(coalesce(max(CASE WHEN p_size % 5 = 3 THEN 1 END), 0) AS INT) AS self_play_enabled,
coalesce(max(CASE WHEN p_size % 5 = 4 THEN p_type END), '') AS hidden_units FROM part GROUP BY 1, 2""",
)
def config_feature_flags(spark, sf_dir):
    paths = F.array(
        *[F.lit(x) for x in ("trainer_type", "reward_signals.curiosity.gamma", "network_settings.memory.size", "self_play.window", "network_settings.hidden_units")]
    )
    conf = table(spark, sf_dir, "part").select(
        F.concat(F.lit("r"), (F.col("p_partkey") % 20).cast("string")).alias("run_id"), F.col("p_brand").alias("behavior"),
        F.get(paths, F.col("p_size") % 5).alias("key_path"), F.col("p_type").alias("value"),
    )
    out = K.config_features(conf)
    return out.select(
        "run_id", "behavior", *[F.col(f"{c}_enabled").cast("int").alias(f"{c}_enabled") for c in ("curiosity", "recurrent", "self_play")],
        F.coalesce("hidden_units", F.lit("")).alias("hidden_units"),
    )


@query(
    "episodes_with_parameters",
    f"""WITH {experiences_sql(64)}, ep AS (SELECT agent_id, episode, 'p' || (agent_id % 5) AS param, episode % 5 AS lesson
  FROM exps GROUP BY ALL HAVING bool_or(done))
SELECT agent_id, episode, n_nationkey AS value FROM ep JOIN nation ON 'p' || (n_nationkey % 5) = param AND n_nationkey // 5 = lesson""",
)
def episodes_with_parameters(spark, sf_dir):
    ep = S.episode_summary(experiences(spark, sf_dir)).select(
        "agent_id", "episode", F.concat(F.lit("p"), (F.col("agent_id") % 5).cast("string")).alias("param"), (F.col("episode") % 5).alias("lesson")
    )
    n = F.col("n_nationkey")
    params = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("p"), (n % 5).cast("string")).alias("param"), F.floor(n / 5).alias("lesson"), n.alias("value")
    )
    return K.with_parameters(ep, params).select("agent_id", "episode", "value")


# --- extension points ------------------------------------------------------------------------


def _weights():
    i = np.arange(64)
    return np.stack([((i * 7 + c * 3) % 5 - 2).astype(float) for c in range(4)], axis=1), np.array([0.0, 0.5, -0.5, 0.25])


@query(
    "policy_scores",
    f"""WITH {EMB_SQL}, l AS (SELECT vec_id, list_transform([0, 1, 2, 3], lambda c: [0.0, 0.5, -0.5, 0.25][c + 1] + list_sum(list_transform(
  v, lambda y, i: y * (((i - 1) * 7 + c * 3) % 5 - 2)))) AS g FROM e)
SELECT vec_id, {r('g[1]')} AS l0, {r('g[4]')} AS l3, CAST(list_position(g, list_max(g)) - 1 AS BIGINT) AS action FROM l""",
)
def policy_scores(spark, sf_dir):
    out = X.score_policy(embeddings(spark, sf_dir), [_weights()], "v", ["vec_id"])
    return out.select("vec_id", steady(F.col("logits")[0]).alias("l0"), steady(F.col("logits")[3]).alias("l3"), "action")


@query("recurrent_policy_actions", f"WITH {STEPS_SQL}, c AS (SELECT agent_id, tick, sum(k) OVER (PARTITION BY agent_id ORDER BY tick) AS s FROM steps) SELECT agent_id, tick, CAST(s % 5 AS BIGINT) AS action FROM c")
def recurrent_policy_actions(spark, sf_dir):
    st = steps(spark, sf_dir, *AGENT, "tick", "k").withColumn("obs", F.array(F.col("k").cast("double")))

    def cell(x, memory):
        memory = memory + x
        return memory[:, 0].astype(np.int64) % 5, memory

    return X.score_recurrent(st, AGENT, "tick", "obs", 1, cell, []).select("agent_id", "tick", "action")


@query(
    "reward_signals_evaluated",
    f"""WITH {EMB_SQL}, d AS (SELECT vec_id, v, list_sum(list_transform(list_zip(v[1:32], v[33:64]), lambda z: power(z[1] - z[2], 2))) AS sq FROM e)
SELECT vec_id, 'curiosity' AS signal, {r('0.02::DOUBLE * 0.5 * sq')} AS reward FROM d UNION ALL SELECT vec_id, 'rnd', {r('0.01::DOUBLE * sq')} FROM d
UNION ALL SELECT vec_id, 'gail', {r('-ln(1 - 1 / (1 + exp(-v[1])) * (1 - 1e-7::DOUBLE))')} FROM d""",
)
def reward_signals_evaluated(spark, sf_dir):
    e = embeddings(spark, sf_dir).select(
        "vec_id", F.slice("v", 1, 32).alias("predicted"), F.slice("v", 33, 32).alias("actual"),
        (1.0 / (1.0 + F.exp(-F.col("v")[0]))).alias("estimate"),
    )
    out = X.evaluate_signals(e, {"curiosity": {"weight": 0.02}, "rnd": {"weight": 0.01}, "gail": {}}, ["vec_id"])
    return out.select("vec_id", "signal", steady("reward").alias("reward"))


@query(
    "reward_processed",
    f"""WITH {experiences_sql(8)} SELECT agent_id, episode, segment, {r('max(reward) - min(reward)')} AS spread FROM exps GROUP BY ALL""",
)
def reward_processed(spark, sf_dir):
    # Each trajectory's rewards: at most `horizon` values per call.
    spread = X.reward_processor(lambda v: v.max() - v.min())
    out = experiences(spark, sf_dir, horizon=8).groupBy("agent_id", "episode", "segment").agg(spread("reward").alias("spread"))
    return out.select("agent_id", "episode", "segment", steady("spread").alias("spread"))


@query(
    "rewards_processed_in_parts",
    f"""WITH {experiences_sql(8)} SELECT behavior_id, {r('max(reward) - min(reward) + avg(reward)')} AS reward FROM exps GROUP BY 1""",
)
def rewards_processed_in_parts(spark, sf_dir):
    """A few groups that hold the whole log."""
    p = X.Processor(
        start=lambda: np.array([np.inf, -np.inf, 0.0, 0.0]),
        update=lambda s, v: np.array([min(s[0], v.min()), max(s[1], v.max()), s[2] + v.sum(), s[3] + len(v)]),
        merge=lambda a, b: np.array([min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], a[3] + b[3]]),
        finish=lambda s: s[1] - s[0] + s[2] / s[3],
    )
    out = X.processed(experiences(spark, sf_dir, horizon=8), ["behavior_id"], "reward", p)
    return out.select("behavior_id", steady("reward").alias("reward"))


@query(
    "sql_named_functions",
    f"""WITH {STEPS_SQL} SELECT tick, CASE WHEN k > 50 THEN 1.0::DOUBLE WHEN k < 50 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS result,
CAST(split_part(behavior_id, '=', 2) AS INT) AS team, 'agent_' || worker_id || '-' || agent_id AS gid,
{r('0.8::DOUBLE * (1 - least(tick, 5000) / 5000.0::DOUBLE) + 0.2::DOUBLE')} AS beta FROM steps""",
)
def sql_named_functions(spark, sf_dir):
    named.register(spark)
    st = steps(spark, sf_dir, "tick", "k", "behavior_id", "worker_id", "agent_id")
    out = st.selectExpr(
        "tick", "match_result(cast(k - 50 as double)) AS result", "behavior_team(behavior_id) AS team",
        "agent_gid(worker_id, agent_id) AS gid", "linear_decay(cast(tick as double), 1D, 0.2D, 5000D) AS beta",
    )
    return out.withColumn("beta", steady("beta"))
