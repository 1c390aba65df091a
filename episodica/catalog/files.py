"""File formats: written from the given tables, read back through the sources."""

import struct

import pandas as pd
from pyspark.sql import functions as F

from episodica.catalog import EPISODES_SQL, STEPS_SQL, experiences_sql, query, r, table
from episodica.catalog.sessions import CORE, experiences, steps
from episodica.catalog.reporting import EVENT_METHODS
from episodica.functions.numbers import steady
from episodica.operators import sessions as S
from episodica.operators import stats as O
from episodica.operators.plugins import parquet_writer
from episodica.plans.folds import python_partitions
from episodica.plans.lineage import fresh_dir
from episodica.schema import AGENT
from episodica.sources import demos, logs
from episodica.sources import replay as R
from episodica.sources import steps as ST
from episodica.sources.demo_ranges import demo_catalog, read_demos, register
from episodica.sources.files import write_files


@query(
    "step_log_scanned",
    f"WITH {STEPS_SQL} SELECT tick, agent_id, behavior_id, {r('reward', 3)} AS reward, CAST(is_terminal AS INT) AS is_terminal FROM steps",
)
def step_log_scanned(spark, sf_dir):
    path = fresh_dir(spark, "steps")
    st = steps(spark, sf_dir, *CORE, "group_id")
    st = st.withColumn("reward", F.col("reward").cast("float"))
    ST.write_steps(st, path)
    out = ST.read_steps(spark, path)
    return out.select(
        "tick", "agent_id", "behavior_id", steady(F.round(F.col("reward").cast("double"), 5), 3).alias("reward"),
        F.col("is_terminal").cast("int").alias("is_terminal"),
    )


@query(
    "replay_saved_and_loaded",
    f"WITH {experiences_sql(64)} SELECT agent_id, tick, next_tick, {r('reward')} AS reward, k AS \"obs:0\" FROM exps",
)
def replay_saved_and_loaded(spark, sf_dir):
    path = fresh_dir(spark, "replay")
    exp = experiences(spark, sf_dir, "k").withColumnRenamed("k", "obs:0")
    R.save_replay(exp.select("behavior_id", "agent_id", "tick", "next_tick", "reward", "obs:0"), path)
    out = R.load_replay(spark, path)
    return out.select("agent_id", "tick", "next_tick", steady("reward").alias("reward"), "obs:0")


@query(
    "replay_loaded_for_a_behavior",
    f"WITH {experiences_sql(64)} SELECT agent_id, tick, k AS obs FROM exps WHERE behavior_id = 'b1?team=1'",
)
def replay_loaded_for_a_behavior(spark, sf_dir):
    path = fresh_dir(spark, "replay")
    R.save_replay(experiences(spark, sf_dir, "k").select("behavior_id", "agent_id", "tick", "k"), path)
    return R.load_replay(spark, path, "b1?team=1").select("agent_id", "tick", F.col("k").alias("obs"))


# --- episode log -----------------------------------------------------------------------------

OUTCOME_SQL = (
    EPISODES_SQL
    + """,
ep AS (SELECT agent_id, episode, CASE max(action) WHEN 4 THEN 'done' WHEN 3 THEN 'crash' ELSE 'open' END AS reason,
  'm' || (agent_id % 2) AS mode, count(*) AS total_steps, floor(sum(reward) * 10 + 0.50001) / 10 AS reward,
  CAST(count_if(action = 1) AS BIGINT) AS reaches FROM seq GROUP BY agent_id, episode)"""
)


def log_lines(spark, sf_dir):
    st = S.with_episode(steps(spark, sf_dir, *AGENT, "tick", "is_terminal", "reward", "action", "k"))
    ep = st.groupBy(*AGENT, "episode").agg(
        F.max("action").alias("a"), F.count(F.lit(1)).alias("n"), steady(F.sum("reward"), 1).alias("r"),
        F.count_if(F.col("action") == 1).alias("p"), F.max("tick").alias("t"),
    )
    reason = F.when(F.col("a") == 4, "done").when(F.col("a") == 3, "crash").otherwise("open")
    end = F.format_string(
        "[2025-01-01 00:00:00] [EPISODE END] reason=%s | mode=m%d | totalSteps=%d | reward=%.1f | ptReaches=%d"
        " | recharges=0 | batteryAtEnd=0.412 | ptRate=0.14 | firstPtStep=%d",
        reason, (F.col("agent_id") % 2), "n", "r", "p", "t",
    )
    stats = F.format_string(
        "[2025-01-01 00:00:00] [EPISODE STATS] ptVisits=%d | recharges=0 | steps=%d | mode=m%d | avgPtVisits=%.2f | avgRecharges=0.00 | eps=%d",
        "p", "n", F.col("agent_id") % 2, F.col("p").cast("double"), "agent_id",
    )
    return ep.select(F.explode(F.array(end, stats)).alias("value"))


def episode_log(spark, sf_dir):
    path = fresh_dir(spark, "episode-log")
    log_lines(spark, sf_dir).write.text(path)
    return logs.read_episode_log(spark, path)


@query(
    "episode_log_parsed",
    f"WITH {OUTCOME_SQL} SELECT reason, mode, total_steps, CAST(reward AS DOUBLE) AS reward, reaches, 1735689600 AS at FROM ep",
)
def episode_log_parsed(spark, sf_dir):
    out = episode_log(spark, sf_dir)
    at = F.unix_timestamp(F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    base = F.unix_timestamp(F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    return out.select("reason", "mode", "total_steps", "reward", "reaches", (at - base + 1735689600).cast("int").alias("at"))


@query(
    "episode_stats_parsed",
    f"WITH {OUTCOME_SQL} SELECT mode, reaches AS pt_visits, 0::BIGINT AS recharges, total_steps AS steps, CAST(agent_id AS BIGINT) AS episodes FROM ep",
)
def episode_stats_parsed(spark, sf_dir):
    path = fresh_dir(spark, "episode-log")
    log_lines(spark, sf_dir).write.text(path)
    return logs.read_episode_stats(spark, path).select("mode", "pt_visits", "recharges", "steps", "episodes")


@query(
    "outcome_rollup",
    f"""WITH {OUTCOME_SQL} SELECT coalesce(mode, '*') AS mode, coalesce(reason, '*') AS reason,
CAST(grouping(mode) * 2 + grouping(reason) AS BIGINT) AS level, count(*) AS episodes, CAST(sum(total_steps) AS BIGINT) AS steps,
{r('avg(reward)')} AS mean_reward, {r('sum(reaches) * 1000.0::DOUBLE / sum(total_steps)')} AS reaches_per_1000
FROM ep GROUP BY ROLLUP (mode, reason)""",
)
def outcome_rollup(spark, sf_dir):
    out = O.outcome_rollup(episode_log(spark, sf_dir))
    return out.select(
        F.coalesce("mode", F.lit("*")).alias("mode"), F.coalesce("reason", F.lit("*")).alias("reason"), "level", "episodes", "steps",
        steady("mean_reward").alias("mean_reward"), steady("reaches_per_1000").alias("reaches_per_1000"),
    )


# --- metric sinks ----------------------------------------------------------------------------


@query(
    "stats_fanned_out",
    """SELECT event_type AS key, count(*) AS num, 2 AS copies FROM events WHERE event_type <> 'error' GROUP BY 1
UNION ALL SELECT event_type, count(*), 1 FROM events WHERE event_type = 'error' GROUP BY 1""",
)
def stats_fanned_out(spark, sf_dir):
    """Two writers and a broken one; the second hides one key."""
    paths = [fresh_dir(spark, "stats"), fresh_dir(spark, "stats")]

    def broken(df):
        raise OSError("no such sink")

    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("num"))
    outcome = O.write_stats(
        s, {"a": parquet_writer(paths[0]), "broken": broken, "b": parquet_writer(paths[1])}, {"b": ["error"]}
    )
    assert outcome["a"] == outcome["b"] == "ok" and outcome["broken"].startswith("failed")
    both = spark.read.parquet(paths[0]).unionByName(spark.read.parquet(paths[1]))
    return both.groupBy("key", "num").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@query(
    "stat_events_scanned",
    """WITH e AS (SELECT *, CASE event_type WHEN 'view' THEN 'MOST_RECENT' WHEN 'signup' THEN 'SUM' WHEN 'error' THEN 'MEDIAN' ELSE 'AVERAGE' END AS method FROM events)
SELECT 'b' || (user_id % 3) AS category, method, CAST(method <> 'MEDIAN' AS INT) AS known, count(*) AS num, CAST(sum(event_id) AS BIGINT) AS seqs
FROM e GROUP BY ALL""",
)
def stat_events_scanned(spark, sf_dir):
    """Events written as JSON lines; those of an unknown method are put aside and counted."""
    path = fresh_dir(spark, "stat-events")
    write_stat_events(spark, sf_dir, path)
    good, bad = logs.split_methods(logs.read_stat_events(spark, path, "json", unknown="keep"))
    both = good.withColumn("known", F.lit(1)).unionByName(bad.withColumn("known", F.lit(0)))
    return both.groupBy("category", "method", "known").agg(F.count(F.lit(1)).alias("num"), F.sum("seq").alias("seqs"))


def write_stat_events(spark, sf_dir, path, where=None):
    method = F.when(F.col("event_type") == "error", "MEDIAN").otherwise(F.create_map(*[F.lit(x) for kv in EVENT_METHODS.items() for x in kv])[F.col("event_type")])
    ev = table(spark, sf_dir, "events")
    ev = ev if where is None else ev.filter(where)
    ev.select(
        F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("category"), F.concat(F.lit("Environment/"), F.col("event_type")).alias("key"),
        "value", method.alias("method"), (F.col("user_id") % 4).cast("int").alias("worker_id"), F.col("event_id").alias("seq"),
    ).write.mode("append").json(path)


# --- timer trees and training status ---------------------------------------------------------


# Conversations in one tree, parts in one run.
PER_TREE, PER_RUN = 50, 100


@query(
    "timer_trees_read",
    f"""WITH t AS (SELECT conv_id, role, sum(length(text)) AS total, count(*) AS n FROM conversations GROUP BY 1, 2),
c AS (SELECT conv_id, sum(total) AS total, sum(n) AS n FROM t GROUP BY 1)
SELECT conv_id // {PER_TREE} AS tree, 'root/' || conv_id || '/' || role AS path, CAST(total AS DOUBLE) AS total, n AS count,
  CAST(role = 'user' AS INT) AS is_parallel FROM t
UNION ALL SELECT conv_id // {PER_TREE}, 'root/' || conv_id, CAST(total AS DOUBLE), CAST(n AS BIGINT), 0 FROM c
UNION ALL SELECT conv_id // {PER_TREE}, 'root', CAST(sum(total) AS DOUBLE), CAST(sum(n) AS BIGINT), 0 FROM c GROUP BY 1""",
)
def timer_trees_read(spark, sf_dir):
    """One file a tree: fifty conversations below its root, their roles below them."""
    per = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(
        F.sum(F.length("text")).cast("double").alias("total"), F.count(F.lit(1)).alias("count")
    )

    def children(name):
        return F.map_from_entries(F.collect_list(F.struct(name, "node"))).alias("children")

    leaf = F.struct("total", "count", (F.col("role") == "user").alias("is_parallel"))
    convs = per.withColumn("node", leaf).groupBy("conv_id").agg(F.sum("total").alias("total"), F.sum("count").alias("count"), children("role"))
    convs = convs.withColumn("node", F.struct("total", "count", "children")).withColumn("tree", F.expr(f"conv_id div {PER_TREE}"))
    name = F.col("conv_id").cast("string").alias("name")
    trees = convs.groupBy("tree").agg(F.sum("total").alias("total"), F.sum("count").alias("count"), children(name))
    content = F.to_json(F.struct(F.lit("root").alias("name"), "total", "count", "children")).alias("content")
    path = fresh_dir(spark, "timers")
    write_files(trees.select(F.concat(F.col("tree").cast("string"), F.lit(".json")).alias("name"), content), path)
    return logs.read_timer_trees(spark, path).select(
        F.regexp_extract("source", r"([0-9]+)\.json$", 1).cast("long").alias("tree"), F.array_join("path", "/").alias("path"), "total", "count",
        F.col("is_parallel").cast("int").alias("is_parallel"),
    )


@query(
    "training_status_read",
    "SELECT 'n' || n_nationkey AS category, 'lesson_num' AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation "
    "UNION ALL SELECT 'n' || n_nationkey, 'elo', CAST(n_nationkey * 10 AS VARCHAR) FROM nation",
)
def training_status_read(spark, sf_dir):
    return _status(spark, sf_dir).filter("key <> 'checkpoints'").select("category", "key", "value")


def _status(spark, sf_dir):
    """One status document per region, its nations being the behaviours."""
    n = F.col("n_nationkey")
    ck = F.array(F.struct(n.cast("long").alias("steps"), F.concat(F.lit("m/"), "n_name").alias("file_path"),
                          F.lit(0.5).alias("reward"), F.lit(1.5e9).alias("creation_time")))
    body = F.struct(F.col("n_regionkey").alias("lesson_num"), (n * 10).alias("elo"), ck.alias("checkpoints"))
    docs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("n"), n.cast("string")), body)))).alias("value")
    )
    path = fresh_dir(spark, "status")
    docs.select("value").repartition(5).write.option("maxRecordsPerFile", 1).text(path)
    return logs.read_training_status(spark, path)


@query(
    "status_checkpoints",
    "SELECT 'n' || n_nationkey AS behavior, CAST(n_nationkey AS BIGINT) AS steps, 'm/' || n_name AS file_path, 0.5::DOUBLE AS reward FROM nation",
)
def status_checkpoints(spark, sf_dir):
    return logs.checkpoints_of(_status(spark, sf_dir)).select("behavior", "steps", "file_path", "reward")


@query(
    "run_configs_read",
    f"""WITH p AS (SELECT 'r' || (p_partkey // {PER_RUN}) || '.yaml' AS run_id, 'p' || p_partkey AS behavior, p_size, p_brand FROM part)
SELECT run_id, behavior, 'hyperparameters.batch_size' AS key_path, CAST(p_size AS VARCHAR) AS value FROM p
UNION ALL SELECT run_id, behavior, 'trainer_type', 'ppo' FROM p
UNION ALL SELECT run_id, behavior, 'tags.0', p_brand FROM p
UNION ALL SELECT DISTINCT run_id, '*', 'engine_settings.time_scale', '20' FROM p""",
)
def run_configs_read(spark, sf_dir):
    """One file a run, a hundred behaviours in each."""
    doc = F.format_string(
        "  p%d:\n    trainer_type: ppo\n    tags: ['%s']\n    hyperparameters:\n      batch_size: %d\n", F.col("p_partkey").cast("long"), "p_brand", F.col("p_size").cast("long")
    )
    parts = table(spark, sf_dir, "part").select(F.expr(f"p_partkey div {PER_RUN}").alias("run"), doc.alias("doc"))
    body = F.concat(F.lit("behaviors:\n"), F.concat_ws("", F.collect_list("doc")), F.lit("engine_settings:\n  time_scale: 20\n"))
    path = fresh_dir(spark, "configs")
    write_files(parts.groupBy("run").agg(body.alias("content")).select(F.format_string("r%d.yaml", "run").alias("name"), "content"), path)
    return logs.read_run_configs(spark, path).withColumn("run_id", F.regexp_extract("run_id", r"([^/]+)$", 1))


# --- demonstrations --------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(n: int, v) -> bytes:
    if isinstance(v, float):
        return _varint(n << 3 | 5) + struct.pack("<f", v)
    if isinstance(v, int):
        return _varint(n << 3) + _varint(v)
    return _varint(n << 3 | 2) + _varint(len(v)) + v


def demo_bytes(name: str, rows: list[tuple], version: int = 1) -> bytes:
    """Bytes of a demonstration of (reward, done, interrupted, agent, obs, discrete action) rows."""
    total = sum(x[0] for x in rows)
    meta = _field(1, version) + _field(2, name.encode()) + _field(3, len(rows)) + _field(4, 1) + _field(5, float(total))
    head = (_varint(len(meta)) + meta).ljust(33, b"\0")
    spec = _field(7, name.encode()) + _field(9, _field(1, 0) + _field(2, 1) + _field(3, _varint(5)))
    out = [head, _varint(len(spec)), spec]
    for reward, done, interrupted, agent, obs, action in rows:
        data = struct.pack(f"<{len(obs)}f", *obs)
        ob = _field(1, _varint(len(obs))) + _field(4, _field(1, data))
        info = _field(7, float(reward)) + _field(8, int(done)) + _field(9, int(interrupted)) + _field(10, agent) + _field(13, ob)
        act = _field(1, struct.pack("<f", action)) + _field(7, _varint(action))
        pair = _field(1, info) + _field(2, act)
        out += [_varint(len(pair)), pair]
    return b"".join(out)


# Ticks of the log in one demonstration file and in one of a single agent, and bytes of records in one range of a file.
CLIP, OWN_CLIP = 5000, 500
SPLIT = 1 << 16


def recorded(spark, sf_dir, own=False):
    """One demonstration per span of ticks (so of bounded length), of all agents or one `own` to each, as (path, content)."""
    st = steps(spark, sf_dir, *CORE, "k", "action")
    clip = F.concat_ws("-", "agent_id", F.expr(f"tick div {OWN_CLIP}")) if own else F.expr(f"tick div {CLIP}")
    st = st.withColumn("clip", clip)
    row = F.struct("tick", "agent_id", "reward", "is_terminal", "interrupted", "k", "action")
    clips = python_partitions(st, ["clip"]).groupBy("clip").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    @F.pandas_udf("binary")
    def encode(rows: pd.Series) -> pd.Series:
        return pd.Series(
            [
                demo_bytes("demo", [(x["reward"], x["is_terminal"], x["interrupted"], int(x["agent_id"]), [float(x["k"])], int(x["action"])) for x in rs])
                for rs in rows
            ]
        )

    return clips.select(F.col("clip").cast("string").alias("path"), encode("rows").alias("content"))


def recorded_files(spark, sf_dir):
    """The demonstrations written once, to a folder of even and one of odd ones."""
    files = recorded(spark, sf_dir).select("path", F.concat("path", F.lit(".demo")).alias("name"), "content")
    folders = [fresh_dir(spark, "demos") for _ in range(2)]
    written = [write_files(files.filter(F.col("path") % 2 == k), folder) for k, folder in enumerate(folders)]
    return [folder for folder, n in zip(folders, written) if n]


def clip_name():
    return F.regexp_extract("path", r"([0-9]+)\.demo$", 1).alias("path")


CLIPS_SQL = (
    STEPS_SQL
    + f""",
clip AS (SELECT *, CAST(tick // {CLIP} AS VARCHAR) AS path,
  row_number() OVER (PARTITION BY tick // {CLIP} ORDER BY tick) - 1 AS n FROM steps)"""
)


@query(
    "demonstrations_read",
    f"""WITH {CLIPS_SQL} SELECT path, n AS tick, agent_id, {r('reward', 3)} AS reward, CAST(is_terminal AS INT) AS is_terminal,
CAST(interrupted AS INT) AS interrupted, k AS obs, CAST(action AS INT) AS action, 'demo' AS behavior_id FROM clip""",
)
def demonstrations_read(spark, sf_dir):
    """Two folders as one set; each file is read by several tasks."""
    out = read_demos(spark, recorded_files(spark, sf_dir), SPLIT)
    return out.select(
        clip_name(), "tick", "agent_id", steady(F.round("reward", 5), 3).alias("reward"), F.col("is_terminal").cast("int").alias("is_terminal"),
        F.col("interrupted").cast("int").alias("interrupted"), F.col("obs")[0][0].cast("long").alias("obs"),
        F.col("discrete")[0].alias("action"), "behavior_id",
    )


@query(
    "demonstrations_by_format",
    f"""WITH {CLIPS_SQL} SELECT agent_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS obs FROM clip WHERE (tick // {CLIP}) % 2 = 0 GROUP BY agent_id""",
)
def demonstrations_by_format(spark, sf_dir):
    """The data source over one folder."""
    register(spark)
    out = spark.read.format("demonstrations").option("split", SPLIT).load(recorded_files(spark, sf_dir)[0])
    return out.groupBy("agent_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("obs")[0][0].cast("long")).alias("obs"))


@query(
    "demonstration_catalog",
    f"""WITH {CLIPS_SQL} SELECT path, count(*) AS number_steps, {r('sum(reward)', 2)} AS mean_reward, 1 AS version, 5 AS branch, 1 AS width
FROM clip GROUP BY path""",
)
def demonstration_catalog(spark, sf_dir):
    out = demo_catalog(spark, recorded_files(spark, sf_dir))
    return out.select(
        clip_name(), "number_steps", steady(F.round("mean_reward", 4), 2).alias("mean_reward"), "version",
        F.col("discrete_branches")[0].alias("branch"), F.col("shapes")[0][0].alias("width"),
    )


@query(
    "demonstration_summaries",
    f"""WITH {CLIPS_SQL} SELECT path, count(*) AS number_steps, CAST(sum(CAST(is_terminal AS INT)) AS BIGINT) AS number_episodes,
CAST(sum(CAST(is_terminal AS INT)) AS BIGINT) + 1 AS recorded_episodes,
{r('sum(reward) / (sum(CAST(is_terminal AS INT)) + 1)', 3)} AS recorded_mean_reward FROM clip GROUP BY path""",
)
def demonstration_summaries(spark, sf_dir):
    out = demos.demo_summary(read_demos(spark, recorded_files(spark, sf_dir), SPLIT))
    return out.select(
        clip_name(), "number_steps", "number_episodes", "recorded_episodes",
        steady(F.round("recorded_mean_reward", 5), 3).alias("recorded_mean_reward"),
    )


@query(
    "demonstration_experiences",
    f"""WITH {CLIPS_SQL}, x AS (SELECT *, lead(k) OVER w AS nk, lead(is_terminal) OVER w AS d, lag(action) OVER w AS pa
  FROM clip WINDOW w AS (PARTITION BY path ORDER BY n))
SELECT path, n AS tick, k AS obs, nk AS next_obs, CAST(d AS INT) AS done, coalesce(pa, 0) AS prev_action FROM x WHERE nk IS NOT NULL""",
)
def demonstration_experiences(spark, sf_dir):
    used = ["path", "tick", "reward", "is_terminal", "interrupted", "obs", "old_action"]
    found = read_demos(spark, recorded_files(spark, sf_dir), SPLIT)
    out = demos.demo_experiences(found.select(*used), cross_episode=True)
    return out.select(
        clip_name(), "tick", F.col("obs")[0][0].cast("long").alias("obs"), F.col("next_obs")[0][0].cast("long").alias("next_obs"),
        F.col("done").cast("int").alias("done"), F.col("prev_action")[0].cast("int").alias("prev_action"),
    )


OWN_CLIPS_SQL = (
    STEPS_SQL
    + f""",
clip AS (SELECT *, agent_id || '-' || (tick // {OWN_CLIP}) AS path,
  row_number() OVER (PARTITION BY agent_id, tick // {OWN_CLIP} ORDER BY tick) - 1 AS n FROM steps)"""
)


@query(
    "demonstrations_by_sql",
    f"WITH {OWN_CLIPS_SQL} SELECT path, count(*) AS n, CAST(sum(agent_id) AS BIGINT) AS agents, CAST(sum(CAST(is_terminal AS INT)) AS BIGINT) AS ends FROM clip GROUP BY path",
)
def demonstrations_by_sql(spark, sf_dir):
    demos.register_table_functions(spark)
    recorded(spark, sf_dir, own=True).createOrReplaceTempView("recorded_demos")
    return spark.sql(
        "SELECT path, count(*) AS n, sum(d.agent_id) AS agents, sum(cast(d.is_terminal AS INT)) AS ends "
        "FROM recorded_demos, LATERAL demo_rows(content) d GROUP BY path"
    )
