"""Curricula, ratings, opponents, teams; the SQL side recurses row by row."""

from pyspark.sql import functions as F

from episodica.catalog import EPISODES_SQL, STEPS_SQL, query, r
from episodica.catalog.reporting import TOTAL, TRAJ_SQL, trajectories
from episodica.catalog.sessions import steps
from episodica.functions.numbers import spread_key, spread_sql, steady
from episodica.operators import selfplay as P
from episodica.operators import sessions as S
from episodica.schema import AGENT

CURRICULUM = {
    "size": [
        P.Lesson("b", "reward", 0.3, 5, True, True, "small"),
        P.Lesson("b", "progress", 0.5, 1, False, False, "mid"),
        P.Lesson(name="large"),
    ],
    "wind": [P.Lesson("b", "reward", 1.0, 3, False, False, "calm"), P.Lesson(name="storm")],
}


def evaluations(spark, sf_dir):
    """Every step row reads as one evaluation of its agent's run, so that runs grow with the log."""
    return steps(spark, sf_dir, "agent_id", "tick", "reward").select(
        F.col("agent_id").cast("string").alias("run"), F.col("tick").alias("seq"), F.lit("b").alias("behavior"),
        (F.col("tick") / 10000.0).alias("progress"), F.col("reward").alias("episode_return"),
    )


@query(
    "curriculum_lessons",
    f"""WITH RECURSIVE {STEPS_SQL},
ev AS (SELECT CAST(agent_id AS VARCHAR) AS run, tick AS seq, reward AS ret, tick / 10000.0::DOUBLE AS progress,
  row_number() OVER (PARTITION BY agent_id ORDER BY tick) AS n FROM steps),
rec AS (
  SELECT DISTINCT run, 0::BIGINT AS n, (-1)::BIGINT AS seq, 0 AS l1, 0 AS l2, 0.0::DOUBLE AS s1, []::DOUBLE[] AS buf,
    false AS c1, false AS c2 FROM ev
  UNION ALL
  SELECT run, n, seq, l1 + CAST(c1 AS INT), l2 + CAST(c2 AS INT), s1n,
    CASE WHEN c1 OR c2 THEN []::DOUBLE[] ELSE b END, c1, c2 FROM (
    SELECT *, CASE l1 WHEN 0 THEN len(b) >= 5 AND s1n > 0.3 WHEN 1 THEN len(b) >= 1 AND progress > 0.5 ELSE false END AS c1,
      l2 = 0 AND len(b) >= 3 AND list_avg(b) > 1.0 AS c2 FROM (
      SELECT *, CASE WHEN l1 = 0 AND len(b) >= 5 THEN 0.25::DOUBLE * s1 + 0.75::DOUBLE * list_avg(b) ELSE s1 END AS s1n FROM (
        SELECT ev.run, ev.n, ev.seq, ev.progress, rec.l1, rec.l2, rec.s1,
          list_append(CASE WHEN len(rec.buf) >= 5 THEN rec.buf[2:] ELSE rec.buf END, ev.ret) AS b
        FROM rec JOIN ev ON ev.run = rec.run AND ev.n = rec.n + 1))))
SELECT run, seq, 'size' AS param, l1 AS lesson, CAST(l1 = 1 AS INT) AS must_reset FROM rec WHERE c1
UNION ALL SELECT run, seq, 'wind', l2, 0 FROM rec WHERE c2""",
)
def curriculum_lessons(spark, sf_dir):
    out = P.lesson_progress(evaluations(spark, sf_dir), CURRICULUM)
    return out.withColumn("must_reset", F.col("must_reset").cast("int"))


def matches(spark, sf_dir):
    """Steps read as matches: the action names the player, k picks one of the four others."""
    return steps(spark, sf_dir, "agent_id", "tick", "action", "k", "reward", "group_reward").select(
        F.col("agent_id").alias("league"), F.col("tick").alias("seq"), F.col("action").alias("slot"),
        ((F.col("action") + 1 + F.col("k") % 4) % 5).cast("int").alias("opponent_slot"),
        F.col("reward").alias("final_reward"), (F.lit(0.0)).alias("final_group_reward"),
    )


MATCH_SQL = """
mt AS (SELECT agent_id AS league, tick AS seq, action AS slot, CAST((action + 1 + k % 4) % 5 AS INT) AS opp,
  CASE WHEN reward > 0 THEN 1.0::DOUBLE WHEN reward < 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS res,
  row_number() OVER (PARTITION BY agent_id ORDER BY tick) AS n FROM steps),
rec AS (
  SELECT DISTINCT league, 0::BIGINT AS n, (-1)::BIGINT AS seq, 0 AS slot, 0 AS opp, 0.0::DOUBLE AS change,
    [1200.0, 1200.0, 1200.0, 1200.0, 1200.0]::DOUBLE[] AS rt FROM mt
  UNION ALL
  SELECT league, n, seq, slot, opp, ch, list_transform(rt, lambda x, i: CASE WHEN i = slot + 1 THEN x + ch
     WHEN i = opp + 1 THEN x - ch ELSE x END) FROM (
    SELECT m.*, rec.rt, 16 * (m.res - 1 / (1 + power(10.0::DOUBLE, (rec.rt[m.opp + 1] - rec.rt[m.slot + 1]) / 400))) AS ch
    FROM rec JOIN mt m ON m.league = rec.league AND m.n = rec.n + 1))"""


@query(
    "ratings_between_players",
    f"""WITH RECURSIVE {STEPS_SQL}, {MATCH_SQL} SELECT league, seq, slot, opp AS opponent_slot, {r('change')} AS change,
{r('rt[slot + 1]')} AS rating, {r('rt[opp + 1]')} AS opponent_rating FROM rec WHERE n > 0""",
)
def ratings_between_players(spark, sf_dir):
    out = P.elo(matches(spark, sf_dir), k=16.0)
    return out.select(
        "league", "seq", "slot", "opponent_slot", *[steady(c).alias(c) for c in ("change", "rating", "opponent_rating")]
    )


PLAN = P.SelfPlay(save_steps=40, swap_steps=30, team_change=60, window=4, latest_ratio=0.5)
THREE = P.SelfPlay(save_steps=25, swap_steps=45, team_change=70, window=3, latest_ratio=0.4, teams=3)
NAME_SQL, TEAM_SQL = "split_part(behavior_id, '?', 1)", "CAST(split_part(behavior_id, '=', 2) AS INT)"
# Arrivals in a block of the schedule's order.
WIDTH = 4096


def schedule_sql(plan, name=NAME_SQL, team=TEAM_SQL):
    """Row by row, in the total order of the trajectories of a name; then the draw for each team that doesn't learn."""
    return f"""
named AS (SELECT *, {name} AS name, {team} AS team FROM traj),
ord AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {TOTAL}) AS n FROM named),
rec AS (
  SELECT DISTINCT name, 0::BIGINT AS n, 0::BIGINT AS round, 0::BIGINT AS swap, 1::BIGINT AS saved, 1::BIGINT AS snapshots,
    0::BIGINT AS ls, 0::BIGINT AS gs, 0::BIGINT AS lc, 0::BIGINT AS lv, 0::BIGINT AS lw FROM ord
  UNION ALL
  SELECT name, n, round + CAST(ch AS INT), swap + CAST(sw AS INT), CASE WHEN sw THEN snapshots + CAST(sv AS INT) ELSE saved END,
    snapshots + CAST(sv AS INT), ls, gs, CASE WHEN ch THEN ls ELSE lc END, CASE WHEN sv THEN ls ELSE lv END,
    CASE WHEN sw THEN gs ELSE lw END FROM (
    SELECT *, ch OR gs - lw > {plan.swap_steps} AS sw FROM (
      SELECT *, ls - lc > {plan.team_change} AS ch, ls - lv > {plan.save_steps} AS sv FROM (
        SELECT o.name, o.n, rec.round, rec.swap, rec.saved, rec.snapshots, rec.lc, rec.lv, rec.lw,
          rec.ls + CASE WHEN o.team = rec.round % {plan.teams} THEN o.length ELSE 0 END AS ls,
          rec.gs + CASE WHEN o.team = rec.round % {plan.teams} THEN 0 ELSE o.length END AS gs
        FROM rec JOIN ord o ON o.name = rec.name AND o.n = rec.n + 1)))),
sched AS (SELECT o.*, rec.round, rec.swap, rec.saved, rec.snapshots, o.team = rec.round % {plan.teams} AS mine
  FROM ord o JOIN rec ON rec.name = o.name AND rec.n = o.n - 1),
others AS (SELECT *, CASE WHEN latest THEN -1 ELSE CAST(floor({spread_sql(f'swap * {plan.teams} + other', 99)} / 4294967296.0::DOUBLE
    * least(saved, {plan.window})) AS BIGINT) END AS slot FROM (
  SELECT *, swap = 0 OR {spread_sql(f'swap * {plan.teams} + other')} / 4294967296.0::DOUBLE >= {1 - plan.latest_ratio} AS latest
  FROM sched, (SELECT range AS other FROM range({plan.teams})) WHERE other <> round % {plan.teams})),
drawn AS (SELECT * FROM others QUALIFY row_number() OVER (PARTITION BY name, n ORDER BY other DESC) = 1)"""


def snapshot_sql(plan):
    return f"""CAST(latest AS INT) AS plays_latest, slot, CASE WHEN slot = -1 THEN -1 ELSE
(SELECT max(g) FROM (SELECT unnest(generate_series(0, saved - 1)) AS g) WHERE g % {plan.window} = slot) END AS snapshot"""


def final_trajectories(spark, sf_dir, *columns):
    """Trajectories with the rewards of their last step."""
    aggs = [F.max_by(c, "i").alias(f"final_{c}") for c in ("reward", *columns)]
    aggs.append(F.max(F.col("interrupted").cast("int")).cast("boolean").alias("interrupted"))
    return P.named_teams(trajectories(spark, sf_dir, *aggs, columns=columns))


def opponents(traj, plan, *keep):
    def draw(team):
        event = F.col("swap") * plan.teams + team
        return tuple(spread_key(event, o) / F.lit(4294967296.0) for o in (0, 99))

    return P.drawn_opponents(P.self_play_schedule(traj, plan, width=WIDTH, keep=keep), plan, draw)


@query(
    "opponents_drawn",
    f"""WITH RECURSIVE {TRAJ_SQL}, {schedule_sql(PLAN)}
SELECT behavior_id, agent_id, arrival, swap, snapshots, {snapshot_sql(PLAN)} FROM drawn""",
)
def opponents_drawn(spark, sf_dir):
    out = opponents(P.named_teams(trajectories(spark, sf_dir)), PLAN)
    plays = F.col("plays_latest").cast("int").alias("plays_latest")
    return out.select("behavior_id", "agent_id", "arrival", "swap", "snapshots", plays, "slot", "snapshot")


@query(
    "opponents_of_three_teams",
    f"""WITH RECURSIVE {TRAJ_SQL}, {schedule_sql(THREE, "'all'", "CAST(agent_id % 3 AS INT)")}
SELECT agent_id, arrival, round % 3 AS learning_team, swap, CAST(other AS BIGINT) AS team, {snapshot_sql(THREE)} FROM others""",
)
def opponents_of_three_teams(spark, sf_dir):
    """One game of three teams for the whole log: one key with all rows, and a draw for each team that doesn't learn."""
    traj = trajectories(spark, sf_dir).withColumns({"name": F.lit("all"), "team": (F.col("agent_id") % 3).cast("int")})
    out = opponents(traj, THREE).withColumn("o", F.explode("opponents"))
    plays = F.col("o.plays_latest").cast("int").alias("plays_latest")
    return out.select("agent_id", "arrival", "learning_team", "swap", "o.team", plays, "o.slot", "o.snapshot")


@query(
    "learning_teams",
    f"""WITH RECURSIVE {TRAJ_SQL}, {schedule_sql(PLAN)}
SELECT name, round, CAST(sum(CASE WHEN mine THEN length ELSE 0 END) AS BIGINT) AS learning_steps,
 CAST(sum(CASE WHEN mine THEN 0 ELSE length END) AS BIGINT) AS ghost_steps FROM sched GROUP BY 1, 2""",
)
def learning_teams(spark, sf_dir):
    traj = P.named_teams(trajectories(spark, sf_dir))
    _, ghosts = P.learning_team_only(P.self_play_schedule(traj, PLAN, width=WIDTH))
    return ghosts


def ladder_sql(window):
    """Ratings after each result of res (name, m, snapshots, slot, result), m counting a name's results from 1."""
    return f"""lad AS (
  SELECT DISTINCT name, 0::BIGINT AS m, 0::BIGINT AS slot, 0::BIGINT AS taken, 0.0::DOUBLE AS change, 1200.0::DOUBLE AS own,
    1200.0::DOUBLE AS other, [1200.0 FOR i IN range({window})]::DOUBLE[] AS rt FROM res
  UNION ALL
  SELECT name, m, slot, snapshots, change, CASE WHEN slot >= 0 THEN own + change ELSE own END,
    CASE WHEN slot >= 0 THEN other - change ELSE other END,
    list_transform(rt, lambda x, i: CASE WHEN i = slot + 1 THEN x - change ELSE x END) FROM (
    SELECT *, result - 1 / (1 + power(10.0::DOUBLE, (other - own) / 400)) AS change FROM (
      SELECT *, CASE WHEN slot < 0 THEN own ELSE rt[slot + 1] END AS other FROM (
        SELECT r.name, r.m, r.slot, r.snapshots, r.result, lad.own, list_transform(lad.rt, lambda x, i: CASE WHEN r.snapshots - lad.taken >= {window}
            OR (i - 1 - lad.taken % {window} + {window}) % {window} < r.snapshots - lad.taken THEN lad.own ELSE x END) AS rt
        FROM lad JOIN res r ON r.name = lad.name AND r.m = lad.m + 1))))"""


# Sixteen neighbouring agents are one arena: a league of its own, so that leagues grow with the log.
ARENA = 16


@query(
    "elo_ratings",
    f"""WITH RECURSIVE {TRAJ_SQL}, {schedule_sql(PLAN, f"{NAME_SQL} || '/' || agent_id // {ARENA}")},
fin AS (SELECT behavior_id, worker_id, agent_id, episode, segment, arg_max(reward, i) + arg_max(group_reward, i) AS final_reward,
  bool_or(interrupted) AS interrupted FROM exps GROUP BY ALL),
res AS (SELECT d.name, d.behavior_id, d.agent_id, d.arrival, d.snapshots, d.slot,
    CASE WHEN final_reward > 0 THEN 1.0::DOUBLE WHEN final_reward < 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS result,
    row_number() OVER (PARTITION BY d.name ORDER BY d.n) AS m
  FROM drawn d JOIN fin USING (behavior_id, worker_id, agent_id, episode, segment) WHERE mine AND done AND NOT interrupted),
{ladder_sql(PLAN.window)}
SELECT behavior_id, agent_id, arrival, res.slot, {r('change')} AS change, {r('own')} AS rating, {r('other')} AS opponent_rating
FROM lad JOIN res USING (name, m)""",
)
def elo_ratings(spark, sf_dir):
    traj = final_trajectories(spark, sf_dir, "group_reward")
    traj = traj.withColumn("name", F.concat_ws("/", "name", F.expr(f"agent_id div {ARENA}")))
    results = P.rated(opponents(traj, PLAN, "done", "interrupted", "final_reward", "final_group_reward"))
    order = ["arrival", "worker_id", "agent_id", "behavior_id", "episode", "segment"]
    out = P.ladder(results.withColumnRenamed("name", "league"), PLAN.window, order)
    return out.select(
        "behavior_id", "agent_id", "arrival", "slot",
        *[steady(c).alias(c) for c in ("change", "rating", "opponent_rating")],
    )


@query(
    "paths_thinned",
    f"""WITH RECURSIVE {EPISODES_SQL},
p AS (SELECT agent_id, episode, i, tick, k / 50.0::DOUBLE AS x, action / 4.0::DOUBLE AS y FROM seq),
rec AS (SELECT agent_id, episode, i, tick, x, y, true AS kept, x AS kx, y AS ky FROM p WHERE i = 0
  UNION ALL
  SELECT p.agent_id, p.episode, p.i, p.tick, p.x, p.y, far, CASE WHEN far THEN p.x ELSE kx END, CASE WHEN far THEN p.y ELSE ky END
  FROM (SELECT p.*, rec.kx, rec.ky, (p.x - kx) * (p.x - kx) + (p.y - ky) * (p.y - ky) >= 0.25 AS far FROM rec
   JOIN p ON p.agent_id = rec.agent_id AND p.episode = rec.episode AND p.i = rec.i + 1) p)
SELECT agent_id, episode, tick, {r('x')} AS x, {r('y')} AS y FROM rec WHERE kept""",
)
def paths_thinned(spark, sf_dir):
    st = S.with_episode(steps(spark, sf_dir, *AGENT, "tick", "is_terminal", "k", "action"))
    pos = st.select("agent_id", "episode", "tick", (F.col("k") / 50.0).alias("x"), (F.col("action") / 4.0).alias("y"))
    out = P.path_points(pos, ["agent_id", "episode"], "tick", ["x", "y"])
    return out.select("agent_id", "episode", "tick", steady("x").alias("x"), steady("y").alias("y"))
