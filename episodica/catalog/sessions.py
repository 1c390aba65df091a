"""Episodes, experiences, trajectories."""

from pyspark.sql import functions as F

from episodica.catalog import EPISODES_SQL, STEPS_SQL, experiences_sql, query, r, table
from episodica.functions.numbers import steady
from episodica.operators import sessions as S
from episodica.schema import AGENT
from episodica.sources.steps import steps_from_events

HORIZON = 64
CORE = ("behavior_id", "worker_id", "agent_id", "tick", "is_terminal", "interrupted", "reward")


def steps(spark, sf_dir, *columns):
    return steps_from_events(table(spark, sf_dir, "events"), *columns)


def experiences(spark, sf_dir, *extra, horizon=HORIZON, behind=None):
    return S.to_experiences(steps(spark, sf_dir, *CORE, *extra), horizon, behind=behind)


@query(
    "behavior_return_and_length",
    f"""WITH {experiences_sql(HORIZON)},
ep AS (SELECT behavior_id, agent_id, episode, sum(reward) AS ret,
              sum(CASE WHEN done THEN 0 ELSE 1 END) AS len
       FROM exps GROUP BY ALL HAVING bool_or(done))
SELECT behavior_id, count(*) AS n_episodes, {r('avg(ret)')} AS mean_return,
       {r('avg(len)')} AS mean_length FROM ep GROUP BY 1""",
)
def behavior_return_and_length(spark, sf_dir):
    ep = S.episode_summary(experiences(spark, sf_dir))
    return ep.groupBy("behavior_id").agg(
        F.count(F.lit(1)).alias("n_episodes"),
        steady(F.avg("episode_return")).alias("mean_return"),
        steady(F.avg("episode_length")).alias("mean_length"),
    )


@query(
    "episode_numbering",
    f"WITH {EPISODES_SQL} SELECT agent_id, tick, episode, i FROM seq",
)
def episode_numbering(spark, sf_dir):
    out = S.with_episode(steps(spark, sf_dir, *AGENT, "tick", "is_terminal"))
    return out.select("agent_id", "tick", "episode", "i")


@query(
    "experience_rows",
    f"""WITH {experiences_sql(HORIZON)} SELECT agent_id, tick, next_tick, episode, segment, i, action,
{r('reward')} AS reward, {r('group_reward')} AS group_reward, CAST(done AS INT) AS done,
CAST(interrupted AS INT) AS interrupted FROM exps""",
)
def experience_rows(spark, sf_dir):
    exp = experiences(spark, sf_dir, "group_reward", "action")
    return exp.select(
        "agent_id", "tick", "next_tick", "episode", "segment", "i", "action",
        steady("reward").alias("reward"), steady("group_reward").alias("group_reward"),
        F.col("done").cast("int").alias("done"), F.col("interrupted").cast("int").alias("interrupted"),
    )


@query(
    "trajectory_cuts",
    f"""WITH {experiences_sql(4)} SELECT agent_id, episode, segment, count(*) AS length,
max(next_tick) AS arrival, max(CAST(done AS INT)) AS done, {r('sum(reward)')} AS reward
FROM exps GROUP BY agent_id, episode, segment HAVING bool_or(done) OR count(*) >= 4""",
)
def trajectory_cuts(spark, sf_dir):
    exp = experiences(spark, sf_dir, horizon=4)
    t = S.trajectories(exp, 4, F.sum("reward").alias("reward"))
    return t.select(
        "agent_id", "episode", "segment", "length", "arrival",
        F.col("done").cast("int").alias("done"), steady("reward").alias("reward"),
    )


@query(
    "next_and_previous_action",
    f"""WITH {experiences_sql(4)} SELECT agent_id, tick, action,
coalesce(lead(action) OVER w, 0) AS next_action, coalesce(lead(action) OVER w, action) AS next_mate_action,
coalesce(a0, 0) AS prev_action
FROM exps WINDOW w AS (PARTITION BY agent_id, episode, segment ORDER BY i)""",
)
def next_and_previous_action(spark, sf_dir):
    exp = experiences(spark, sf_dir, "action", horizon=4, behind=["action"]).drop("next_action")
    out = S.with_prev_action(S.with_next(exp, "action", "action"))
    return out.select("agent_id", "tick", "action", "next_action", "next_mate_action", "prev_action")


@query(
    "episode_return_per_agent",
    f"""WITH {experiences_sql(HORIZON)} SELECT agent_id, episode, {r('sum(reward)')} AS episode_return
FROM exps GROUP BY ALL HAVING bool_or(done)""",
)
def episode_return_per_agent(spark, sf_dir):
    ep = S.episode_returns(experiences(spark, sf_dir))
    return ep.select("agent_id", "episode", steady("episode_return").alias("episode_return"))


@query(
    "episode_length_per_agent",
    f"""WITH {experiences_sql(HORIZON)} SELECT agent_id, episode,
CAST(sum(CASE WHEN done THEN 0 ELSE 1 END) AS BIGINT) AS episode_length, count(*) AS n_experiences
FROM exps GROUP BY agent_id, episode HAVING bool_or(done)""",
)
def episode_length_per_agent(spark, sf_dir):
    ep = S.episode_lengths(experiences(spark, sf_dir))
    return ep.select("agent_id", "episode", "episode_length", "n_experiences")


@query(
    "rolling_episode_returns",
    f"""WITH {experiences_sql(HORIZON)},
ep AS (SELECT behavior_id, agent_id, episode, sum(reward) AS ret, max(next_tick) AS end_tick
       FROM exps GROUP BY ALL HAVING bool_or(done))
SELECT behavior_id, end_tick, row_number() OVER w - 1 AS rank,
  {r('avg(ret) OVER (PARTITION BY behavior_id ORDER BY end_tick ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)')}
    AS rolling_return FROM ep WINDOW w AS (PARTITION BY behavior_id ORDER BY end_tick)""",
)
def rolling_episode_returns(spark, sf_dir):
    out = S.rolling_returns(S.episode_summary(experiences(spark, sf_dir)), 10)
    return out.select("behavior_id", "end_tick", "rank", steady("rolling_return").alias("rolling_return"))


@query(
    "padded_sequences",
    f"""WITH {experiences_sql(HORIZON)},
n AS (SELECT *, count(*) OVER (PARTITION BY agent_id, episode, segment) AS len FROM exps),
pads AS (SELECT agent_id, episode, segment, j + p AS j, 0.0 AS reward, 1 AS k_ones, 0 AS mask
         FROM (SELECT *, unnest(generate_series(1, (4 - len % 4) % 4)) AS p FROM n WHERE j = len - 1)),
kk AS (SELECT pads.agent_id, pads.episode, pads.segment, pads.j, pads.reward, n.k, pads.mask
       FROM pads JOIN n ON n.agent_id = pads.agent_id AND n.episode = pads.episode
        AND n.segment = pads.segment AND n.j = n.len - 1),
al AS (SELECT agent_id, episode, segment, j, reward, k, 1 AS mask FROM n
       UNION ALL SELECT * FROM kk)
SELECT agent_id, episode, segment, j // 4 AS seq, j % 4 AS pos, {r('reward')} AS reward, k,
       CAST(mask AS INT) AS mask FROM al""",
)
def padded_sequences(spark, sf_dir):
    exp = experiences(spark, sf_dir, "k")
    out = S.resequence(exp, 4, {"reward": 0.0, "k": 1.0})
    return out.select(
        "agent_id", "episode", "segment", "seq", "pos", steady("reward").alias("reward"), "k",
        F.col("mask").cast("int").alias("mask"),
    )


@query(
    "overlapping_sequences",
    f"""WITH {experiences_sql(HORIZON)},
w AS (SELECT agent_id, episode, segment, j - 2 AS seq, j,
      list(k) OVER (PARTITION BY agent_id, episode, segment ORDER BY i
                    ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS win FROM exps)
SELECT agent_id, episode, segment, seq, win[1] AS first_k, win[3] AS last_k,
       CAST(list_sum(win) AS BIGINT) AS sum_k FROM w WHERE len(win) = 3""",
)
def overlapping_sequences(spark, sf_dir):
    out = S.sliding_sequences(experiences(spark, sf_dir, "k"), 3, "k")
    return out.select(
        "agent_id", "episode", "segment", "seq",
        F.col("window")[0].alias("first_k"), F.col("window")[2].alias("last_k"),
        F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_k"),
    )


@query(
    "stacked_observations",
    f"""WITH {EPISODES_SQL}
SELECT agent_id, tick, coalesce(lag(k, 2) OVER w, 0) AS s0, coalesce(lag(action, 2) OVER w, 0) AS s1,
  coalesce(lag(k, 1) OVER w, 0) AS s2, coalesce(lag(action, 1) OVER w, 0) AS s3, k AS s4, action AS s5
FROM seq WINDOW w AS (PARTITION BY agent_id, episode ORDER BY tick)""",
)
def stacked_observations(spark, sf_dir):
    st = S.with_episode(steps(spark, sf_dir, *AGENT, "tick", "is_terminal", "k", "action"))
    st = st.withColumn("obs", F.array(F.col("k"), F.col("action").cast("long")))
    out = S.stack_obs(st, 3, size=2)
    return out.select("agent_id", "tick", *[F.col("stacked")[n].alias(f"s{n}") for n in range(6)])


@query(
    "decision_rows",
    f"WITH {STEPS_SQL} SELECT behavior_id, count(*) AS n FROM steps WHERE NOT is_terminal GROUP BY 1",
)
def decision_rows(spark, sf_dir):
    rows = S.decision_rows(steps(spark, sf_dir, "behavior_id", "is_terminal"))
    return rows.groupBy("behavior_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "terminal_rows",
    f"WITH {STEPS_SQL} SELECT behavior_id, tick, agent_id FROM steps WHERE is_terminal",
)
def terminal_rows(spark, sf_dir):
    return S.terminal_rows(steps(spark, sf_dir, "behavior_id", "tick", "agent_id", "is_terminal")).drop(
        "is_terminal"
    )


@query(
    "decision_period_ticks",
    f"WITH {STEPS_SQL} SELECT tick, agent_id FROM steps WHERE tick % 5 = 2",
)
def decision_period_ticks(spark, sf_dir):
    return S.decision_ticks(steps(spark, sf_dir, "tick", "agent_id"), 5, 2)


@query(
    "actions_attached",
    f"""WITH {experiences_sql(HORIZON)} SELECT agent_id, tick, next_tick, action, {r('reward')} AS reward
FROM exps""",
)
def actions_attached(spark, sf_dir):
    st = steps(spark, sf_dir, *CORE, "action")
    joined = S.attach_actions(st.drop("action"), st.select(*AGENT, "tick", "action"))
    exp = S.to_experiences(joined, HORIZON)
    return exp.select("agent_id", "tick", "next_tick", "action", steady("reward").alias("reward"))


@query(
    "actions_filled_forward",
    f"""WITH {STEPS_SQL} SELECT agent_id, tick,
coalesce(last_value(CASE WHEN tick % 5 = 0 THEN action END IGNORE NULLS)
  OVER (PARTITION BY agent_id ORDER BY tick ROWS UNBOUNDED PRECEDING), -1) AS filled_action FROM steps""",
)
def actions_filled_forward(spark, sf_dir):
    st = steps(spark, sf_dir, *AGENT, "tick", "action")
    chosen = F.when(F.pmod("tick", F.lit(5)) == 0, F.col("action"))
    out = S.fill_actions(st.withColumn("action", chosen))
    return out.select("agent_id", "tick", F.coalesce("filled_action", F.lit(-1)).alias("filled_action"))


@query(
    "reward_between_decisions",
    f"""WITH {STEPS_SQL},
d AS (SELECT agent_id, tick, value AS amount, event_type = 'error' AS is_set, event_type = 'view' AS dec,
      coalesce(sum(CAST(event_type = 'view' AS INT)) OVER (PARTITION BY agent_id ORDER BY tick
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS decision FROM steps),
m AS (SELECT *, coalesce(max(CASE WHEN is_set THEN tick END) OVER (PARTITION BY agent_id, decision), -1)
        AS st FROM d)
SELECT agent_id, CAST(decision AS BIGINT) AS decision, max(tick) AS tick, {r('sum(amount)')} AS reward
FROM m WHERE tick >= st GROUP BY agent_id, decision HAVING bool_or(dec)""",
)
def reward_between_decisions(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ticks = steps_from_events(ev.select("*"), *AGENT, "tick", "reward", "action").select(
        *AGENT, "tick",
        F.when(F.col("action") == 3, "set").otherwise("add").alias("op"),
        ((F.col("reward") + 0.5) * 100.0).alias("amount"),
        (F.col("action") == 1).alias("is_decision"),
    )
    out = S.reward_since_decision(ticks).filter("closed = 1")
    return out.select("agent_id", "decision", "tick", steady("reward").alias("reward"))


@query(
    "agents_seen",
    f"""WITH {STEPS_SQL} SELECT behavior_id, count(DISTINCT agent_id) AS n_agents, count(*) AS n_steps
FROM steps GROUP BY 1""",
)
def agents_seen(spark, sf_dir):
    from episodica.operators.stats import seen

    out = seen(steps(spark, sf_dir, "behavior_id", "agent_id"), ["behavior_id"], "agent_id")
    return out.withColumnsRenamed({"n_seen": "n_agents", "n_rows": "n_steps"})


@query(
    "first_error_rates",
    f"""WITH {EPISODES_SQL} SELECT agent_id, episode,
coalesce(min(CASE WHEN event_type = 'error' THEN i END), -1) AS first_error_step, count(*) AS total_steps,
{r("sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 1000.0::DOUBLE / count(*)")} AS errors_per_1000
FROM seq GROUP BY agent_id, episode""",
)
def first_error_rates(spark, sf_dir):
    from episodica.operators.stats import episode_rates

    st = S.with_episode(steps(spark, sf_dir, *AGENT, "tick", "is_terminal", "action"))
    out = episode_rates(st, F.col("action") == 3)
    return out.select(
        "agent_id", "episode", F.coalesce("first_step", F.lit(-1)).alias("first_error_step"), "total_steps",
        steady("rate_per_1000").alias("errors_per_1000"),
    )
