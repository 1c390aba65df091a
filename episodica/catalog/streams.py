"""Streaming operators over the event log as a file stream; same SQL as their batch twins."""

from pyspark.sql import functions as F

from episodica.catalog import SQL, STEPS_SQL, experiences_sql, query, r, table
from episodica.catalog import files, reporting, selfplay
from episodica.functions.numbers import steady
from episodica.plans.lineage import fresh_dir
from episodica.schema import STAT_EVENTS
from episodica.sources import logs
from episodica.sources.steps import instant, steps_from_events
from episodica.streaming import agents, folds
from episodica.streaming import stats as SS
from episodica.streaming.sources import run_available, run_batches, stream_steps


def live_events(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return stream_steps(spark, sf_dir, schema=schema, per_trigger=1, options={"pathGlobFilter": "events.parquet"})


BATCHES = 4
# The micro-batch that brings an event: quarters of the range of ids, events without one in the last.
BATCH_SQL = f"""coalesce(CAST((event_id - (SELECT min(event_id) FROM events)) * {BATCHES}
  // ((SELECT max(event_id) FROM events) - (SELECT min(event_id) FROM events) + 1) AS BIGINT), {BATCHES - 1})"""
ROWS_PER_FILE = 100_000


def batched_events(spark, sf_dir):
    """The event log as files that come in as many micro-batches: each batch admits the files of one part, written by as many tasks as its rows ask for."""
    ev, path = table(spark, sf_dir, "events"), fresh_dir(spark, "live")
    low, high, n = ev.agg(F.min("event_id"), F.max("event_id"), F.count(F.lit(1))).first()
    last = F.lit(BATCHES - 1)
    part = last if low is None else F.coalesce(F.floor((F.col("event_id") - low) * BATCHES / (high - low + 1)).cast("int"), last)
    files = max(1, n // (BATCHES * ROWS_PER_FILE))
    for k in range(BATCHES):
        ev.filter(part == k).repartition(files).write.mode("append").parquet(path)
    return stream_steps(spark, path, schema=ev.schema, per_trigger=files)


def live_steps(spark, sf_dir, *columns, batched=False):
    events = batched_events(spark, sf_dir) if batched else live_events(spark, sf_dir)
    return steps_from_events(events, *columns)


@query(
    "stream_trajectories",
    f"""WITH {experiences_sql(4)}, t AS (SELECT agent_id, episode, segment FROM exps GROUP BY ALL
  HAVING bool_or(done) OR count(*) >= 4)
SELECT e.agent_id, e.episode, e.segment, i, tick, next_tick, {r('reward')} AS reward, CAST(done AS INT) AS done, k, next_k
FROM exps e JOIN t ON t.agent_id = e.agent_id AND t.episode = e.episode AND t.segment = e.segment""",
)
def stream_trajectories(spark, sf_dir):
    st = live_steps(spark, sf_dir, *LIVE, "k", batched=True)
    return assembled(agents.stream_trajectories(st, 4, {"k": "long"}))


LIVE = ("behavior_id", "worker_id", "agent_id", "tick", "is_terminal", "interrupted", "reward")


def assembled(stream):
    out = run_available(stream)
    return out.select(
        "agent_id", "episode", "segment", "i", "tick", "next_tick", steady("reward").alias("reward"),
        F.col("done").cast("int").alias("done"), "k", "next_k",
    )


@query(
    "stream_trajectories_with_resets",
    f"""WITH {STEPS_SQL},
edge AS (SELECT min(event_id) AS low, max(event_id) - min(event_id) + 1 AS span FROM events),
resets AS (SELECT w.range AS worker_id, low + (span * b.range + {BATCHES - 1}) // {BATCHES} AS tick FROM edge, range(4) w, range(1, {BATCHES}) b
  WHERE w.range <> 1 AND (w.range + b.range) % 2 = 0),
e AS (SELECT *, (SELECT count(*) FROM resets r WHERE r.worker_id = s.worker_id AND r.tick <= s.tick) AS epoch FROM steps s),
numbered AS (SELECT *, CAST(epoch + coalesce(sum(CAST(is_terminal AS INT)) OVER (PARTITION BY agent_id ORDER BY tick
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS episode FROM e),
seq AS (SELECT *, row_number() OVER w - 1 AS i, lead(tick) OVER w AS next_tick, lead(reward) OVER w AS r1, lead(is_terminal) OVER w AS done,
  lead(k) OVER w AS next_k FROM numbered WINDOW w AS (PARTITION BY agent_id, episode ORDER BY tick)),
x AS (SELECT *, i // 4 AS segment FROM seq WHERE next_tick IS NOT NULL),
t AS (SELECT agent_id, episode, segment FROM x GROUP BY ALL HAVING bool_or(done) OR count(*) >= 4)
SELECT agent_id, episode, segment, i, tick, next_tick, {r('r1')} AS reward, CAST(done AS INT) AS done, k, next_k FROM x JOIN t USING (agent_id, episode, segment)""",
)
def stream_trajectories_with_resets(spark, sf_dir):
    """Some workers are reset between micro-batches: what their agents had open is dropped."""
    low, high = table(spark, sf_dir, "events").agg(F.min("event_id"), F.max("event_id")).first()
    ticks = [] if low is None else [(w, low + ((high - low + 1) * b + BATCHES - 1) // BATCHES) for w in range(4) for b in range(1, BATCHES) if w != 1 and (w + b) % 2 == 0]
    path = fresh_dir(spark, "resets")
    spark.createDataFrame(ticks, "worker_id int, tick long").write.parquet(path)
    resets = spark.read.schema("worker_id int, tick long").parquet(path)
    st = agents.with_epoch(live_steps(spark, sf_dir, *LIVE, "k", batched=True), resets)
    return assembled(agents.stream_trajectories(st, 4, {"k": "long"}))


@query(
    "stream_episode_returns",
    f"""WITH {experiences_sql(64)} SELECT agent_id, episode, {r('sum(reward)')} AS episode_return,
CAST(sum(CASE WHEN done THEN 0 ELSE 1 END) AS BIGINT) AS episode_length FROM exps GROUP BY ALL HAVING bool_or(done)""",
)
def stream_episode_returns(spark, sf_dir):
    columns = ("behavior_id", "worker_id", "agent_id", "tick", "is_terminal", "interrupted", "reward")
    out = run_available(agents.stream_episode_returns(live_steps(spark, sf_dir, *columns, batched=True)))
    return out.select("agent_id", "episode", steady("episode_return").alias("episode_return"), "episode_length")


@query(
    "stream_lessons",
    None,
)
def stream_lessons(spark, sf_dir):
    st = live_steps(spark, sf_dir, "agent_id", "tick", "reward", batched=True).select(
        F.col("agent_id").cast("string").alias("run"), F.col("tick").alias("seq"), F.lit("b").alias("behavior"),
        (F.col("tick") / 10000.0).alias("progress"), F.col("reward").alias("episode_return"),
    )
    out = run_available(folds.stream_lessons(st, selfplay.CURRICULUM))
    return out.withColumn("must_reset", F.col("must_reset").cast("int"))


SQL["stream_lessons"] = SQL["curriculum_lessons"]


@query("stream_ratings", SQL["ratings_between_players"])
def stream_ratings(spark, sf_dir):
    st = live_steps(spark, sf_dir, "agent_id", "tick", "action", "k", "reward", batched=True).select(
        F.col("agent_id").alias("league"), F.col("tick").alias("seq"), F.col("action").alias("slot"),
        ((F.col("action") + 1 + F.col("k") % 4) % 5).cast("int").alias("opponent_slot"),
        F.col("reward").alias("final_reward"), F.lit(0.0).alias("final_group_reward"),
    )
    out = run_available(folds.stream_elo(st, k=16.0))
    return out.select(
        "league", "seq", "slot", "opponent_slot", *[steady(c).alias(c) for c in ("change", "rating", "opponent_rating")]
    )


@query(
    "stream_ladder_ratings",
    f"""WITH RECURSIVE {STEPS_SQL},
res AS (SELECT agent_id AS name, tick, 1 + tick // 500 AS snapshots, CASE WHEN k % 3 = 0 THEN -1 ELSE action % least(1 + tick // 500, 4) END AS slot,
  CASE WHEN (reward - 0.5::DOUBLE) + group_reward > 0 THEN 1.0::DOUBLE WHEN (reward - 0.5::DOUBLE) + group_reward < 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS result,
  row_number() OVER (PARTITION BY agent_id ORDER BY tick) AS m FROM steps),
{selfplay.ladder_sql(4)}
SELECT name AS league, tick AS seq, CAST(res.slot AS BIGINT) AS slot, {r('change')} AS change, {r('own')} AS rating, {r('other')} AS opponent_rating
FROM lad JOIN res USING (name, m)""",
)
def stream_ladder_ratings(spark, sf_dir):
    """Steps read as rated results, by the ladder's rules, over several micro-batches."""
    st = live_steps(spark, sf_dir, "agent_id", "tick", "action", "k", "reward", "group_reward", batched=True)
    snapshots = F.expr("1 + tick div 500")
    slot = F.when(F.col("k") % 3 == 0, -1).otherwise(F.col("action") % F.least(snapshots, F.lit(4))).cast("long")
    results = st.select(
        F.col("agent_id").alias("league"), F.col("tick").alias("seq"), snapshots.cast("long").alias("snapshots"), slot.alias("slot"),
        (F.col("reward") - 0.5).alias("final_reward"), F.col("group_reward").alias("final_group_reward"),
    )
    out = run_available(folds.stream_ladder(results, 4))
    return out.select("league", "seq", "slot", *[steady(c).alias(c) for c in ("change", "rating", "opponent_rating")])


@query(
    "stream_stat_events",
    """WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'MOST_RECENT' WHEN 'signup' THEN 'SUM' WHEN 'error' THEN 'MEDIAN' ELSE 'AVERAGE' END AS method FROM events)
SELECT 'b' || (user_id % 3) AS category, method, CAST(method <> 'MEDIAN' AS INT) AS known, count(*) AS num, CAST(sum(event_id) AS BIGINT) AS seqs
FROM e GROUP BY ALL""",
)
def stream_stat_events(spark, sf_dir):
    """Live metric events, some files admitted at a time; events of unknown methods go to a table of their own."""
    path, good, bad = (fresh_dir(spark, x) for x in ("stat-events", "known", "put-aside"))
    for k in range(2):
        files.write_stat_events(spark, sf_dir, path, F.coalesce(F.col("event_id"), F.lit(0)) % 2 == k)
    run_batches(logs.read_stat_events(spark, path, "json", stream=True, unknown="keep", per_trigger=1), SS.known_and_unknown(good, bad))
    both = spark.read.parquet(good).withColumn("known", F.lit(1)).unionByName(spark.read.schema(STAT_EVENTS).parquet(bad).withColumn("known", F.lit(0)))
    return both.groupBy("category", "method", "known").agg(F.count(F.lit(1)).alias("num"), F.sum("seq").alias("seqs"))


def live_stat_events(spark, sf_dir, batched=False):
    ev = batched_events(spark, sf_dir) if batched else live_events(spark, sf_dir)
    pairs = [F.lit(x) for kv in reporting.EVENT_METHODS.items() for x in kv]
    return ev.select(
        F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("category"),
        F.concat(F.lit("Environment/"), F.col("event_type")).alias("key"), "value",
        F.create_map(*pairs)[F.col("event_type")].alias("method"), (F.col("user_id") % 4).cast("int").alias("worker_id"),
        F.col("event_id").alias("seq"), ((F.floor(F.col("event_id") / 500) + 1) * 500).alias("summary_step"),
        instant(ev, "ts").alias("ts"),
    )


@query("stream_stat_summaries", SQL["stat_summaries"])
def stream_stat_summaries(spark, sf_dir):
    """Complete mode: the last micro-batch holds every bucket."""
    out = fresh_dir(spark, "stream-stats")

    def keep(df, batch_id):
        df.write.mode("overwrite").parquet(out)

    stream = SS.stream_stats(live_stat_events(spark, sf_dir))
    run_batches(stream, keep, mode="complete")
    res = spark.read.schema(stream.schema).parquet(out)
    return res.select(
        "category", "key", "summary_step", "num", "method",
        *[steady(c).alias(c) for c in ("mean", "std", "last_value", "aggregated_value")],
    )


@query(
    "stream_env_stats_per_batch",
    f"""WITH {reporting.STAT_SQL}, b AS (SELECT event_id AS seq, {BATCH_SQL} AS batch FROM events)
SELECT batch, category, key, count(*) AS num, {r('avg(value)')} AS mean FROM stat_events JOIN b USING (seq)
WHERE method <> 'MOST_RECENT' OR worker_id = 0 GROUP BY 1, 2, 3""",
)
def stream_env_stats_per_batch(spark, sf_dir):
    """Each micro-batch is summarised by itself."""
    path = fresh_dir(spark, "env-stats")
    run_batches(live_stat_events(spark, sf_dir, batched=True), SS.env_stats_writer(path))
    out = spark.read.parquet(path)
    return out.select(F.col("batch").cast("long").alias("batch"), "category", "key", "num", steady("mean").alias("mean"))


def _windows_sql(size: str, origin_steps: str) -> str:
    return f"""WITH w AS (SELECT 'b' || (user_id % 3) AS category, 'Environment/' || event_type AS key, value, ts, {origin_steps} AS ws FROM events),
m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events)
SELECT category, key, CAST(epoch(ws) AS BIGINT) AS window_start, count(*) AS num, {r('sum(value)')} AS total
FROM w, m GROUP BY category, key, ws, wm HAVING ws + INTERVAL {size} <= wm"""


@query("stream_tumbling_windows", _windows_sql("1 DAY", "date_trunc('day', ts)"))
def stream_tumbling_windows(spark, sf_dir):
    out = run_available(SS.windowed_stats(live_stat_events(spark, sf_dir), "1 day"))
    return _windows(out)


@query(
    "stream_sliding_windows",
    _windows_sql("2 DAY", "unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY])"),
)
def stream_sliding_windows(spark, sf_dir):
    out = run_available(SS.windowed_stats(live_stat_events(spark, sf_dir), "2 days", "1 day"))
    return _windows(out)


def _windows(out):
    return out.select(
        "category", "key", F.unix_timestamp("window.start").alias("window_start"), "num", steady("sum").alias("total")
    )


@query(
    "stream_deduplicated",
    f"WITH {STEPS_SQL} SELECT behavior_id, count(*) AS n, CAST(sum(tick) AS BIGINT) AS ticks FROM steps GROUP BY 1",
)
def stream_deduplicated(spark, sf_dir):
    """Every row delivered twice; each counts once."""
    st = live_steps(spark, sf_dir, "behavior_id", "worker_id", "agent_id", "tick", "is_terminal", "ts")
    doubled = st.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = run_available(SS.dedup_late(doubled))
    return out.groupBy("behavior_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tick").alias("ticks"))


@query(
    "stream_silent_sessions",
    f"""WITH {STEPS_SQL}, g AS (SELECT agent_id, ts, tick, ts - lag(ts) OVER w >= INTERVAL 12 HOUR AS brk FROM steps
  WINDOW w AS (PARTITION BY agent_id ORDER BY ts)),
s AS (SELECT *, coalesce(sum(CAST(brk AS INT)) OVER (PARTITION BY agent_id ORDER BY ts), 0) AS sess FROM g),
m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM events)
SELECT agent_id, count(*) AS n_steps, max(tick) AS last_tick FROM s, m GROUP BY agent_id, sess, wm
HAVING max(ts) + INTERVAL 12 HOUR <= wm""",
)
def stream_silent_sessions(spark, sf_dir):
    st = live_steps(spark, sf_dir, "behavior_id", "worker_id", "agent_id", "tick", "ts")
    out = run_available(SS.silent_sessions(st, "12 hours"))
    return out.select("agent_id", "n_steps", "last_tick")


@query(
    "stream_replay_store",
    f"""WITH {STEPS_SQL}, b AS (SELECT event_id AS tick, {BATCH_SQL} AS batch FROM events),
old AS (SELECT behavior_id, tick, k, row_number() OVER w AS n, count(*) OVER (PARTITION BY behavior_id) AS total
  FROM steps JOIN b USING (tick) WHERE batch <= 2 WINDOW w AS (PARTITION BY behavior_id ORDER BY tick DESC))
SELECT behavior_id, tick, k FROM old WHERE total <= 200 OR n <= 154
UNION ALL SELECT behavior_id, tick, k FROM steps JOIN b USING (tick) WHERE batch = 3""",
)
def stream_replay_store(spark, sf_dir):
    """The third micro-batch compacts the store to its newest whole sequences; the fourth comes on top."""
    path = fresh_dir(spark, "replay")
    st = live_steps(spark, sf_dir, "behavior_id", "tick", "k", batched=True)
    run_batches(st, SS.replay_writer(path, 200, 7, every=2))
    return SS.load_stream_replay(spark, path)


@query(
    "stream_known_behaviors",
    f"""WITH {STEPS_SQL} SELECT tick, agent_id FROM steps WHERE behavior_id IN
 (SELECT 'b' || (n_nationkey % 2) || '?team=' || (n_nationkey % 2) FROM nation)""",
)
def stream_known_behaviors(spark, sf_dir):
    from episodica.operators.checks import known_behaviors

    reg = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("b"), (F.col("n_nationkey") % 2).cast("string"), F.lit("?team="), (F.col("n_nationkey") % 2).cast("string")).alias("behavior_id")
    ).distinct()
    known, _ = known_behaviors(live_steps(spark, sf_dir, "tick", "agent_id", "behavior_id"), reg)
    return run_available(known.select("tick", "agent_id"))
