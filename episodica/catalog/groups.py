"""Group-mate queries; the SQL side joins every mate with an as-of condition instead."""

from pyspark.sql import functions as F

from episodica.catalog import EPISODES_SQL, STEPS_SQL, query, r
from episodica.catalog.sessions import steps
from episodica.functions.numbers import steady
from episodica.operators import groups as G
from episodica.operators import returns as R
from episodica.schema import AGENT

COLUMNS = (*AGENT, "tick", "group_id", "is_terminal", "reward")

# A status row ends the experience that began at the agent's previous row.
STATUS_SQL = (
    EPISODES_SQL
    + """,
st AS (SELECT *, lag(k) OVER w AS prev_k, 2 * tick + CASE WHEN is_terminal THEN 0 ELSE 1 END AS ord,
  CASE WHEN is_terminal THEN 2 * tick + 2 ELSE 9223372036854775807 END AS gone
  FROM seq WINDOW w AS (PARTITION BY agent_id, episode ORDER BY tick)),
status AS (SELECT * FROM st WHERE i > 0),
members AS (SELECT DISTINCT behavior_id, worker_id, group_id, agent_id AS mate FROM status WHERE group_id > 0),
asked AS (SELECT s.*, m.mate FROM status s JOIN members m ON m.behavior_id = s.behavior_id
  AND m.worker_id = s.worker_id AND m.group_id = s.group_id AND m.mate <> s.agent_id),
seen AS (SELECT a.agent_id, a.tick, a.mate, b.reward AS m_reward, b.is_terminal AS m_done, b.prev_k AS m_prev_k,
  b.k AS m_k FROM asked a ASOF JOIN status b ON b.agent_id = a.mate AND b.ord <= a.ord WHERE b.gone > a.ord),
tot AS (SELECT agent_id, tick, count(*) AS n, sum(m_reward) AS mr, sum(CAST(m_done AS INT)) AS nd,
  sum(m_prev_k) AS pk, sum(m_k) AS mk, sum(mate) AS mates FROM seen GROUP BY 1, 2),
res AS (SELECT s.*, coalesce(t.n, 0) AS n_mates, coalesce(t.mr, 0) AS mates_reward,
  CAST(coalesce(t.nd, 0) AS BIGINT) AS n_done_mates, CAST(coalesce(t.pk, 0) AS BIGINT) AS mates_prev_k,
  CAST(coalesce(t.mk, 0) AS BIGINT) AS mates_k, CAST(coalesce(t.mates, 0) AS BIGINT) AS mates_sum
  FROM status s LEFT JOIN tot t ON t.agent_id = s.agent_id AND t.tick = s.tick)"""
)


def status(spark, sf_dir, *extra):
    return G.statuses(steps(spark, sf_dir, *COLUMNS, *extra))


@query(
    "group_mate_totals",
    f"""WITH {STATUS_SQL} SELECT agent_id, tick, n_mates, {r('mates_reward')} AS mates_reward, n_done_mates,
CAST(n_mates = n_done_mates AS INT) AS group_done FROM res""",
)
def group_mate_totals(spark, sf_dir):
    out = G.group_totals(status(spark, sf_dir))
    return out.select(
        "agent_id", "tick", "n_mates", steady("mates_reward").alias("mates_reward"), "n_done_mates",
        F.col("group_done").cast("int").alias("group_done"),
    )


@query(
    "group_status_lists",
    f"""WITH {STATUS_SQL} SELECT agent_id, tick, n_mates, {r('mates_reward')} AS mates_reward, n_done_mates,
mates_prev_k, mates_sum FROM res""",
)
def group_status_lists(spark, sf_dir):
    st = status(spark, sf_dir, "k").withColumn("prev_k", F.col("prv.k")).select(*G.BASE, "prev_k", "reward")

    def totals(lists):
        mates = lists.values
        summed = {"mates_reward": mates.field("reward"), "n_done_mates": mates.field("is_terminal").fill_null(False).cast("int64")}
        summed |= {"mates_prev_k": mates.field("prev_k"), "mates_sum": mates.field("agent_id")}
        return {"n_mates": lists.value_lengths().cast("int64")} | {c: G.sums(lists, x) for c, x in summed.items()}

    columns = "n_mates long, mates_reward double, n_done_mates long, mates_prev_k long, mates_sum long"
    out = G.group_status(st, ["prev_k", "reward", "is_terminal"], (totals, columns))
    return out.select("agent_id", "tick", "n_mates", steady("mates_reward").alias("mates_reward"), "n_done_mates", "mates_prev_k", "mates_sum")


@query(
    "next_group_observations",
    f"""WITH {STATUS_SQL} SELECT agent_id, tick, n_mates, mates_k FROM res
WHERE group_id > 0 AND (is_terminal OR (i - 1) % 4 = 3)""",
)
def next_group_observations(spark, sf_dir):
    def totals(lists):
        return {"n_mates": lists.value_lengths().cast("int64"), "mates_k": G.sums(lists, lists.values.field("k"))}

    st = G.statuses(steps(spark, sf_dir, *AGENT, "tick", "group_id", "is_terminal", "k"))
    out = G.next_group_obs(st, 4, "k", (totals, "n_mates long, mates_k long"))
    return out.select("agent_id", F.floor(F.col("ord") / 2).alias("tick"), "n_mates", "mates_k")


@query(
    "extrinsic_rewards",
    f"""WITH {STATUS_SQL} SELECT agent_id, tick, {r('reward + mates_reward + group_reward')} AS extrinsic FROM res""",
)
def extrinsic_rewards(spark, sf_dir):
    out = R.extrinsic_reward(G.group_totals(status(spark, sf_dir, "group_reward")), "mates_reward", "group_reward")
    return out.select("agent_id", "tick", steady("extrinsic").alias("extrinsic"))


@query(
    "group_returns",
    f"""WITH {STATUS_SQL} SELECT agent_id, episode, {r('sum(group_reward)')} AS group_return, max(tick) AS end_tick
FROM res GROUP BY agent_id, episode HAVING bool_or(is_terminal AND n_mates = n_done_mates)""",
)
def group_returns(spark, sf_dir):
    out = G.group_returns(G.group_totals(status(spark, sf_dir, "group_reward")))
    return out.select("agent_id", "episode", steady("group_return").alias("group_return"), "end_tick")


@query(
    "group_rewards_broadcast",
    f"""WITH {STEPS_SQL},
rw AS (SELECT group_id, tick, k AS amount, event_type = 'error' AS is_set FROM steps WHERE event_type IN ('error', 'view') AND group_id > 0),
d AS (SELECT group_id, agent_id, tick, coalesce(lag(tick) OVER (PARTITION BY group_id, agent_id ORDER BY tick), -1) AS a FROM steps
  WHERE NOT is_terminal AND group_id > 0),
s AS (SELECT d.*, r.tick AS rt, r.amount, max(CASE WHEN is_set THEN r.tick END) OVER (PARTITION BY d.group_id, d.agent_id, d.tick) AS st
  FROM d LEFT JOIN rw r ON r.group_id = d.group_id AND r.tick > d.a AND r.tick <= d.tick)
SELECT agent_id, group_id, tick, CAST(coalesce(sum(CASE WHEN rt >= coalesce(st, -1) THEN amount END), 0) AS BIGINT) AS group_reward
FROM s GROUP BY ALL""",
)
def group_rewards_broadcast(spark, sf_dir):
    st = steps(spark, sf_dir, "group_id", "agent_id", "tick", "k", "action", "is_terminal").filter(F.col("group_id") > 0)
    rewards = st.filter(F.col("action").isin(1, 3)).select(
        "group_id", "tick", F.col("k").alias("amount"), F.when(F.col("action") == 3, "set").otherwise("add").alias("op")
    )
    out = G.broadcast_group_reward(rewards, st.filter(~F.col("is_terminal")).select("group_id", "agent_id", "tick"))
    return out.select("agent_id", "group_id", "tick", F.col("group_reward").cast("long").alias("group_reward"))
