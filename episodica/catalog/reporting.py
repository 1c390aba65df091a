"""Trainer clock, metric summaries, gauges, span trees, checkpoints."""

from pyspark.sql import functions as F

from episodica.catalog import STEPS_SQL, experiences_sql, query, r, table
from episodica.catalog.sessions import experiences, steps
from episodica.functions.numbers import steady
from episodica.operators import sessions as S
from episodica.operators import stats as O
from episodica.schema import TRAJECTORY

H = 4
FREQ = 100

# Sixteen ticks of the log are one tick of the trainer, on which many agents hand over trajectories: their order is that
# of workers, agents, episodes and segments.
TOTAL = "arrival, worker_id, agent_id, behavior_id, episode, segment"
TRAJ_SQL = (
    experiences_sql(H)
    + f""",
traj AS (SELECT behavior_id, worker_id, agent_id, episode, segment, count(*) AS length, max(next_tick) // 16 AS arrival,
  bool_or(done) AS done, sum(reward) AS reward, avg(value_est) AS mean_value
  FROM exps GROUP BY ALL HAVING bool_or(done) OR count(*) >= {H}),
clock AS (SELECT *, CAST(sum(length) OVER (PARTITION BY behavior_id ORDER BY {TOTAL}
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c FROM traj)"""
)

# The method each event type reports with.
EVENT_METHODS = {"click": "AVERAGE", "view": "MOST_RECENT", "signup": "SUM", "error": "HISTOGRAM", "purchase": "AVERAGE"}


def trajectories(spark, sf_dir, *extra_aggs, columns=()):
    out = S.trajectories(experiences(spark, sf_dir, *columns, horizon=H), H, *extra_aggs)
    return out.withColumn("arrival", F.expr("arrival div 16"))


def stat_events(spark, sf_dir):
    """The event log read as metric events: key = event type, seq = event id."""
    pairs = [F.lit(x) for kv in EVENT_METHODS.items() for x in kv]
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("category"),
        F.concat(F.lit("Environment/"), F.col("event_type")).alias("key"),
        "value",
        F.create_map(*pairs)[F.col("event_type")].alias("method"),
        (F.col("user_id") % 4).cast("int").alias("worker_id"),
        F.col("event_id").alias("seq"),
        ((F.floor(F.col("event_id") / 500) + 1) * 500).alias("summary_step"),
        "ts",
    )


STAT_SQL = """
stat_events AS (SELECT 'b' || (user_id % 3) AS category, 'Environment/' || event_type AS key, value,
  CASE event_type WHEN 'view' THEN 'MOST_RECENT' WHEN 'signup' THEN 'SUM' WHEN 'error' THEN 'HISTOGRAM'
    ELSE 'AVERAGE' END AS method,
  user_id % 4 AS worker_id, event_id AS seq, (event_id // 500 + 1) * 500 AS summary_step FROM events)"""


@query("trainer_steps", f"WITH {TRAJ_SQL} SELECT behavior_id, agent_id, arrival, length, c AS trainer_step FROM clock")
def trainer_steps(spark, sf_dir):
    out = O.with_trainer_step(trajectories(spark, sf_dir))
    return out.select("behavior_id", "agent_id", "arrival", "length", "trainer_step")


@query(
    "summary_buckets",
    f"""WITH {TRAJ_SQL},
lab AS (SELECT *, {FREQ} * (c // {FREQ} + 1) AS summary_step, max(c) OVER (PARTITION BY behavior_id) AS m FROM clock)
SELECT behavior_id, summary_step, count(*) AS n_trajectories, {r('avg(reward)')} AS mean_reward
FROM lab WHERE summary_step <= m GROUP BY 1, 2""",
)
def summary_buckets(spark, sf_dir):
    traj = trajectories(spark, sf_dir, F.sum("reward").alias("reward"))
    return O.summary_step(traj, FREQ).groupBy("behavior_id", "summary_step").agg(
        F.count(F.lit(1)).alias("n_trajectories"), steady(F.avg("reward")).alias("mean_reward")
    )


@query(
    "checkpoint_points",
    f"""WITH {TRAJ_SQL} SELECT behavior_id, agent_id, arrival, c - length AS checkpoint_step FROM clock
WHERE c // 50 > (c - length) // 50 AND c - length > 0""",
)
def checkpoint_points(spark, sf_dir):
    return O.checkpoint_steps(trajectories(spark, sf_dir), 50).select("behavior_id", "agent_id", "arrival", "checkpoint_step")


@query(
    "on_policy_update_rounds",
    f"""WITH RECURSIVE {TRAJ_SQL},
ord AS (SELECT *, row_number() OVER (PARTITION BY behavior_id ORDER BY {TOTAL}) AS n FROM clock),
rec AS (SELECT behavior_id, agent_id, n, arrival, length, 0 AS round, length > 40 AS closes,
               CASE WHEN length > 40 THEN 0 ELSE length END AS buf FROM ord WHERE n = 1
  UNION ALL
  SELECT o.behavior_id, o.agent_id, o.n, o.arrival, o.length, rec.round + CAST(rec.closes AS INT),
    rec.buf + o.length > 40, CASE WHEN rec.buf + o.length > 40 THEN 0 ELSE rec.buf + o.length END
  FROM rec JOIN ord o ON o.behavior_id = rec.behavior_id AND o.n = rec.n + 1)
SELECT behavior_id, agent_id, arrival, length, CAST(round AS BIGINT) AS round, CAST(closes AS INT) AS closes FROM rec""",
)
def on_policy_update_rounds(spark, sf_dir):
    out = O.update_rounds(trajectories(spark, sf_dir), 40)
    return out.select("behavior_id", "agent_id", "arrival", "length", "round", F.col("closes").cast("int").alias("closes"))


@query(
    "off_policy_updates_due",
    f"""WITH {TRAJ_SQL} SELECT behavior_id, agent_id, arrival, CAST(c >= 100 AS INT) AS ready,
CAST(CASE WHEN c >= 100 THEN greatest(ceil((c - 100) / 8.0::DOUBLE), 1) - 1 ELSE 0 END AS BIGINT) AS updates_done
FROM clock""",
)
def off_policy_updates_due(spark, sf_dir):
    out = O.updates_due(trajectories(spark, sf_dir), 100, 8.0, 32)
    return out.select("behavior_id", "agent_id", "arrival", F.col("ready").cast("int").alias("ready"), "updates_done")


@query(
    "policy_mean_reward_by_round",
    f"""WITH RECURSIVE {TRAJ_SQL},
ord AS (SELECT *, row_number() OVER (PARTITION BY behavior_id ORDER BY {TOTAL}) AS n FROM clock),
rec AS (SELECT behavior_id, n, done, reward, 0 AS round, length > 40 AS closes,
               CASE WHEN length > 40 THEN 0 ELSE length END AS buf FROM ord WHERE n = 1
  UNION ALL
  SELECT o.behavior_id, o.n, o.done, o.reward, rec.round + CAST(rec.closes AS INT),
    rec.buf + o.length > 40, CASE WHEN rec.buf + o.length > 40 THEN 0 ELSE rec.buf + o.length END
  FROM rec JOIN ord o ON o.behavior_id = rec.behavior_id AND o.n = rec.n + 1)
SELECT behavior_id, CAST(round AS BIGINT) AS round, {r('avg(reward)')} AS mean_reward FROM rec WHERE done GROUP BY 1, 2""",
)
def policy_mean_reward_by_round(spark, sf_dir):
    traj = trajectories(spark, sf_dir, F.sum("reward").alias("episode_return"))
    rounds = O.update_rounds(traj, 40).select(*TRAJECTORY, "round")
    ended = traj.filter("done").join(rounds, list(TRAJECTORY))
    out = O.policy_mean_reward(ended)
    return out.select("behavior_id", "round", steady("mean_reward").alias("mean_reward"))


@query(
    "stat_summaries",
    f"""WITH {STAT_SQL} SELECT category, key, summary_step, {r('avg(value)')} AS mean,
{r('stddev_pop(value)')} AS std, count(*) AS num, {r('arg_max(value, seq)')} AS last_value,
arg_max(method, seq) AS method,
{r("CASE arg_max(method, seq) WHEN 'SUM' THEN sum(value) WHEN 'MOST_RECENT' THEN arg_max(value, seq) ELSE avg(value) END")}
  AS aggregated_value
FROM stat_events WHERE method <> 'MOST_RECENT' OR worker_id = 0 GROUP BY 1, 2, 3""",
)
def stat_summaries(spark, sf_dir):
    out = O.summarise_stats(O.environment_events(stat_events(spark, sf_dir)))
    return out.select(
        "category", "key", "summary_step", "num", "method",
        *[steady(c).alias(c) for c in ("mean", "std", "last_value", "aggregated_value")],
    )


@query(
    "stat_histograms",
    f"""WITH {STAT_SQL} SELECT category, key, CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 400 THEN 17
  ELSE floor(value / 25.0::DOUBLE) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM stat_events GROUP BY 1, 2, 3""",
)
def stat_histograms(spark, sf_dir):
    return O.stat_histogram(stat_events(spark, sf_dir), 0.0, 400.0, 16)


def gauge_events(spark, sf_dir, half):
    ev = table(spark, sf_dir, "events")
    # The clicks hold NaN readings, which a gauge ignores.
    value = F.when(F.col("event_type") == "click", F.lit(float("nan"))).otherwise(F.col("value"))
    mine = F.col("event_type").isin("view", "signup")
    return ev.filter(mine if half else ~mine).select(
        F.concat(F.lit("g"), (F.col("user_id") % 7).cast("string")).alias("name"), value.alias("value"),
        F.col("event_id").alias("seq"),
    )


@query(
    "gauges_merged",
    f"""SELECT 'g' || (user_id % 7) AS name, {r('arg_max(value, event_id)')} AS value,
{r('min(value)')} AS min_value, {r('max(value)')} AS max_value, count(*) AS count
FROM events WHERE event_type <> 'click' GROUP BY 1""",
)
def gauges_merged(spark, sf_dir):
    halves = [O.gauges(gauge_events(spark, sf_dir, h)) for h in (0, 1)]
    out = O.merge_gauges(*halves)
    return out.select("name", "count", *[steady(c).alias(c) for c in ("value", "min_value", "max_value")])


def conversation_spans(spark, sf_dir):
    """Turns read as timed calls: role / turn bucket / odd-even, lasting as long as their text."""
    leaf = F.array(
        F.lit("root"), F.col("role"), F.concat(F.lit("t"), (F.floor(F.col("turn") / 2)).cast("string"))
    )
    rows = table(spark, sf_dir, "conversations").select(
        leaf.alias("leaf"), F.length("text").cast("double").alias("d"), (F.col("turn") == 1).alias("p")
    )
    # A call's time counts for each of its ancestors too.
    return rows.select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size("leaf")), lambda n: F.slice("leaf", F.lit(1), n))).alias("path"),
        F.col("d").alias("total"), F.lit(1).cast("long").alias("count"), F.col("p").alias("is_parallel"),
    )


SPANS_SQL = """
leafs AS (SELECT role, 't' || (turn // 2) AS b, CAST(length(text) AS DOUBLE) AS d, turn = 1 AS p FROM conversations),
spans AS (
  SELECT 'root' AS path, '' AS parent, sum(d) AS total, count(*) AS count, bool_or(p) AS par FROM leafs
  UNION ALL SELECT 'root/' || role, 'root', sum(d), count(*), bool_or(p) FROM leafs GROUP BY role
  UNION ALL SELECT 'root/' || role || '/' || b, 'root/' || role, sum(d), count(*), bool_or(p) FROM leafs GROUP BY role, b)"""


@query(
    "span_tree_totals",
    f"WITH {SPANS_SQL} SELECT path, {r('total')} AS total, count, CAST(par AS INT) AS is_parallel FROM spans",
)
def span_tree_totals(spark, sf_dir):
    out = O.span_totals(conversation_spans(spark, sf_dir))
    return out.select(
        F.array_join("path", "/").alias("path"), steady("total").alias("total"), "count",
        F.col("is_parallel").cast("int").alias("is_parallel"),
    )


@query(
    "span_self_times",
    f"""WITH {SPANS_SQL}, ch AS (SELECT parent, sum(total) AS t FROM spans GROUP BY 1)
SELECT s.path, {r('greatest(0, s.total - coalesce(ch.t, 0))')} AS self_time
FROM spans s LEFT JOIN ch ON ch.parent = s.path""",
)
def span_self_times(spark, sf_dir):
    out = O.span_self_time(O.span_totals(conversation_spans(spark, sf_dir)))
    return out.select(F.array_join("path", "/").alias("path"), steady("self_time").alias("self_time"))


@query(
    "span_trees_merged",
    f"""WITH {SPANS_SQL}, m AS (SELECT path, total, count, par FROM spans
  UNION ALL SELECT 'worker/' || path, total, count, true FROM spans)
SELECT path, {r('sum(total)')} AS total, CAST(sum(count) AS BIGINT) AS count, CAST(bool_or(par) AS INT) AS is_parallel
FROM m GROUP BY 1""",
)
def span_trees_merged(spark, sf_dir):
    t = O.span_totals(conversation_spans(spark, sf_dir))
    out = O.merge_spans(t, t, root="worker")
    return out.select(
        F.array_join("path", "/").alias("path"), steady("total").alias("total"), "count",
        F.col("is_parallel").cast("int").alias("is_parallel"),
    )


@query(
    "metric_name_rollup",
    f"""SELECT coalesce(part, '*') AS part, coalesce(key, '*') AS key, {r('sum(value)')} AS total, count(*) AS num,
 CAST(grouping(part) * 2 + grouping(key) AS BIGINT) AS level
FROM (SELECT 'b' || (user_id % 3) AS part, 'b' || (user_id % 3) || '/' || event_type AS key, value FROM events)
GROUP BY ROLLUP (part, key)""",
)
def metric_name_rollup(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.concat_ws("/", F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")), "event_type").alias("key"), "value"
    )
    out = O.stats_rollup(ev)
    return out.select(
        F.coalesce("part", F.lit("*")).alias("part"), F.coalesce("key", F.lit("*")).alias("key"),
        steady("total").alias("total"), "num", "level",
    )


_WIDE = ", ".join(r(f"max(CASE WHEN key = 'Environment/{k}' THEN v END)") + f" AS {k}_mean" for k in EVENT_METHODS)


@query(
    "wide_metric_export",
    f"""WITH {STAT_SQL}, s AS (SELECT summary_step AS step, key, avg(value) AS v FROM stat_events GROUP BY 1, 2)
SELECT step, {_WIDE} FROM s GROUP BY 1""",
)
def wide_metric_export(spark, sf_dir):
    s = stat_events(spark, sf_dir).groupBy(F.col("summary_step").alias("step"), "key").agg(
        F.avg("value").alias("aggregated_value")
    )
    out = O.export_metrics(s, [f"Environment/{k}" for k in EVENT_METHODS])
    return out.select("step", *[steady(F.col(f"`Environment/{k}`")).alias(f"{k}_mean") for k in EVENT_METHODS])


@query(
    "trajectory_value_stats",
    f"""WITH {TRAJ_SQL},
lab AS (SELECT *, {FREQ} * (c // {FREQ} + 1) AS summary_step, max(c) OVER (PARTITION BY behavior_id) AS m FROM clock)
SELECT behavior_id, summary_step, {r('avg(mean_value)')} AS mean_value_estimate FROM lab
WHERE summary_step <= m GROUP BY 1, 2""",
)
def trajectory_value_stats(spark, sf_dir):
    traj = trajectories(spark, sf_dir, F.avg("value_est").alias("mean_value"), columns=("value_est",))
    out = O.summary_step(traj, FREQ).groupBy("behavior_id", "summary_step").agg(F.avg("mean_value").alias("v"))
    return out.select("behavior_id", "summary_step", steady("v").alias("mean_value_estimate"))


@query(
    "mean_of_trajectory_means",
    f"""WITH {TRAJ_SQL} SELECT behavior_id, {r('avg(mean_value)')} AS value_estimate FROM (
  SELECT behavior_id, agent_id, episode, segment, avg(value_est) AS mean_value FROM exps GROUP BY ALL) GROUP BY 1""",
)
def mean_of_trajectory_means(spark, sf_dir):
    exp = experiences(spark, sf_dir, "value_est", horizon=H)
    out = O.policy_stats(exp, ["agent_id", "worker_id", "episode", "segment"], ["behavior_id"], {"v": "value_est"})
    return out.select("behavior_id", steady("v").alias("value_estimate"))


@query(
    "running_accuracy_average",
    f"""WITH {STEPS_SQL} SELECT behavior_id, tick,
{r('avg(k) OVER (PARTITION BY behavior_id ORDER BY tick ROWS UNBOUNDED PRECEDING)')} AS running_average FROM steps""",
)
def running_accuracy_average(spark, sf_dir):
    out = O.running_average(steps(spark, sf_dir, "behavior_id", "tick", "k"), ["behavior_id"], "tick", "k")
    return out.select("behavior_id", "tick", steady("running_average").alias("running_average"))


@query(
    "adaptive_gradient_clip",
    f"""WITH {STEPS_SQL}, n AS (SELECT behavior_id, tick, value / 20.0::DOUBLE AS norm,
  row_number() OVER (PARTITION BY behavior_id ORDER BY tick) - 1 AS rank FROM steps)
SELECT behavior_id, rank, CASE WHEN rank < 10 THEN 2.0::DOUBLE ELSE
 {r('least(5.0::DOUBLE, avg(norm) OVER w + 2.0::DOUBLE * stddev_pop(norm) OVER w)')} END AS clip_limit
FROM n WINDOW w AS (PARTITION BY behavior_id ORDER BY rank ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
)
def adaptive_gradient_clip(spark, sf_dir):
    from episodica.plans.ordered import prefix

    norms = steps(spark, sf_dir, "behavior_id", "tick", "reward").withColumn("norm", (F.col("reward") + 0.5) * 5.0)
    ranked = prefix(norms, ["behavior_id"], "tick", {"rank": F.lit(1)}, inclusive=False)
    out = O.adaptive_clip(ranked.select("behavior_id", "rank", "norm"), ["behavior_id"])
    limit = F.when(F.col("rank") < 10, F.lit(2.0)).otherwise(steady("clip_limit"))
    return out.select("behavior_id", "rank", limit.alias("clip_limit"))


@query(
    "reward_gate",
    f"""WITH {experiences_sql(64)},
ep AS (SELECT behavior_id, agent_id, episode, sum(reward) AS ret, max(next_tick) AS end_tick
       FROM exps GROUP BY ALL HAVING bool_or(done)),
l AS (SELECT *, row_number() OVER (PARTITION BY behavior_id ORDER BY end_tick DESC) AS n FROM ep)
SELECT behavior_id, {r('avg(ret)')} AS mean_last, CAST(avg(ret) > -1.0 AS INT) AS passed FROM l WHERE n <= 5 GROUP BY 1""",
)
def reward_gate(spark, sf_dir):
    out = O.reward_gate(S.episode_summary(experiences(spark, sf_dir)), 5, -1.0)
    return out.select("behavior_id", steady("mean_last").alias("mean_last"), F.col("passed").cast("int").alias("passed"))


def order_checkpoints(spark, sf_dir):
    """Orders read as checkpoints of a customer's run."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("behavior"),
        F.col("o_orderkey").alias("steps"),
        F.concat(F.lit("run/"), F.col("o_orderkey").cast("string"), F.lit(".pt")).alias("file_path"),
        F.col("o_totalprice").alias("reward"),
        F.unix_timestamp("o_orderdate").alias("creation_time"),
    )


_RANKED = """ck AS (SELECT 'c' || o_custkey AS behavior, o_orderkey AS steps, 'run/' || o_orderkey || '.pt' AS file_path,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)"""


@query("checkpoints_kept", f"WITH {_RANKED} SELECT behavior, steps, file_path FROM ck WHERE n <= 3")
def checkpoints_kept(spark, sf_dir):
    return O.keep_checkpoints(order_checkpoints(spark, sf_dir), 3).select("behavior", "steps", "file_path")


@query("checkpoints_expired", f"WITH {_RANKED} SELECT behavior, steps, file_path FROM ck WHERE n > 3")
def checkpoints_expired(spark, sf_dir):
    return O.expired_checkpoints(order_checkpoints(spark, sf_dir), 3).select("behavior", "steps", "file_path")


@query(
    "latest_policies",
    f"""WITH {STEPS_SQL} SELECT behavior_id, max(tick) AS version, arg_max(agent_id, tick) AS agent_id,
arg_max(k, tick) AS k FROM steps GROUP BY 1""",
)
def latest_policies(spark, sf_dir):
    st = steps(spark, sf_dir, "behavior_id", "tick", "agent_id", "k").withColumnRenamed("tick", "version")
    return O.latest_policy(st)
