"""Discounting and advantages, checked against recursive SQL."""

from pyspark.sql import functions as F

from episodica.catalog import experiences_sql, query, r
from episodica.catalog.sessions import experiences
from episodica.functions.numbers import steady
from episodica.operators import returns as R

H = 64


def _recursive(base: str, q: str) -> str:
    """Backward recurrence over each trajectory: independent of the window form."""
    return f"""WITH RECURSIVE {experiences_sql(H)},
len AS (SELECT *, max(i) OVER (PARTITION BY agent_id, episode, segment) AS last_i FROM exps),
d AS (SELECT *, CAST({base} AS DOUBLE) AS d FROM len),
rec AS (
  SELECT agent_id, episode, segment, i, d AS x FROM d WHERE i = last_i
  UNION ALL
  SELECT d.agent_id, d.episode, d.segment, d.i, d.d + {q}::DOUBLE * rec.x
  FROM rec JOIN d ON d.agent_id = rec.agent_id AND d.episode = rec.episode
   AND d.segment = rec.segment AND d.i = rec.i - 1)"""


def boot(spark, sf_dir, *extra):
    return R.bootstrap(experiences(spark, sf_dir, "value_est", *extra, horizon=H))


@query(
    "discounted_returns",
    _recursive("reward + CASE WHEN i = last_i THEN 0.99::DOUBLE * v_next ELSE 0 END", "0.99")
    + f" SELECT agent_id, episode, i, {r('x')} AS discounted_return FROM rec",
)
def discounted_returns(spark, sf_dir):
    out = R.discounted_returns(boot(spark, sf_dir), 0.99, H)
    return out.select("agent_id", "episode", "i", steady("discounted_return").alias("discounted_return"))


@query(
    "generalised_advantages",
    _recursive("reward + 0.99::DOUBLE * v_next - value_est", "0.9405")
    + f""" SELECT rec.agent_id, rec.episode, rec.i, {r('x')} AS advantage,
{r('x + e.value_est')} AS returns FROM rec JOIN exps e
ON e.agent_id = rec.agent_id AND e.episode = rec.episode AND e.i = rec.i""",
)
def generalised_advantages(spark, sf_dir):
    out = R.gae(boot(spark, sf_dir), 0.99, 0.95, H)
    return out.select(
        "agent_id", "episode", "i",
        steady("advantage").alias("advantage"), steady("returns").alias("returns"),
    )


@query(
    "lambda_returns",
    _recursive(
        "reward + CASE WHEN i = last_i THEN 0.99::DOUBLE ELSE 0.99::DOUBLE * (1.0::DOUBLE - 0.95::DOUBLE) END"
        " * v_next",
        "0.9405",
    )
    + f""" SELECT rec.agent_id, rec.episode, rec.i, {r('x')} AS lambda_return,
{r('x - e.value_est')} AS baseline_advantage FROM rec JOIN exps e
ON e.agent_id = rec.agent_id AND e.episode = rec.episode AND e.i = rec.i""",
)
def lambda_returns(spark, sf_dir):
    exp = boot(spark, sf_dir).withColumn("baseline", F.col("value_est"))
    out = R.lambda_return(exp, 0.99, 0.95, H)
    return out.select(
        "agent_id", "episode", "i", steady("lambda_return").alias("lambda_return"),
        steady("baseline_advantage").alias("baseline_advantage"),
    )


@query(
    "bootstrap_values",
    f"""WITH {experiences_sql(H)} SELECT agent_id, tick, {r('v_next')} AS v_next,
{r('next_value')} AS v_next_ignoring_done FROM exps""",
)
def bootstrap_values(spark, sf_dir):
    exp = experiences(spark, sf_dir, "value_est", horizon=H)
    both = R.bootstrap(R.bootstrap(exp, ignore_done=True).withColumnRenamed("v_next", "w"))
    return both.select("agent_id", "tick", steady("v_next").alias("v_next"), steady("w").alias("v_next_ignoring_done"))


@query(
    "combined_signals",
    f"""WITH {experiences_sql(H)},
s AS (SELECT agent_id, tick, reward + 0.99::DOUBLE * v_next - value_est AS a, value_est AS v FROM exps
  UNION ALL
  SELECT agent_id, tick, group_reward + 0.9::DOUBLE * v_next - value_est, value_est FROM exps)
SELECT agent_id, tick, {r('avg(a)')} AS advantage, {r('avg(a + v)')} AS returns FROM s GROUP BY 1, 2""",
)
def combined_signals(spark, sf_dir):
    exp = boot(spark, sf_dir, "group_reward")
    a = R.gae(exp, 0.99, 0.0, H, "reward")
    b = R.gae(exp, 0.9, 0.0, H, "group_reward")
    cols = ["agent_id", "tick", "advantage", "returns"]
    out = R.combine_signals(a.select(*cols).unionByName(b.select(*cols)), ["agent_id", "tick"])
    return out.select(
        "agent_id", "tick", steady("advantage").alias("advantage"), steady("returns").alias("returns")
    )


@query(
    "off_policy_terminals",
    f"""WITH {experiences_sql(H)} SELECT agent_id, tick, k,
CASE WHEN done AND interrupted THEN k ELSE next_k END AS next_k,
CAST(done AND NOT interrupted AS INT) AS done FROM exps""",
)
def off_policy_terminals(spark, sf_dir):
    from episodica.catalog.sessions import CORE, steps
    from episodica.operators.sessions import to_experiences

    st = steps(spark, sf_dir, *CORE, "k").withColumnRenamed("k", "obs")
    out = R.off_policy_fix(to_experiences(st, H))
    return out.select(
        "agent_id", "tick", F.col("obs").alias("k"), F.col("next_obs").alias("next_k"),
        F.col("done").cast("int").alias("done"),
    )
