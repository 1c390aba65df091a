"""Folds: resets, ratings, curricula, thinning."""

import random

import pytest

from pyspark.sql import functions as F

from episodica.operators import selfplay as P
from episodica.operators import stats as O
from episodica.plans.clocks import NUMBERED, Limits, two_clocks
from episodica.plans.folds import threshold_resets


@pytest.mark.parametrize("limit,width", [(10, 5), (40, 16), (3, 7), (1000, 8), (25, 1 << 18)])
def test_threshold_resets(spark, limit, width):
    rng = random.Random(limit)
    rows, want = [], {}
    for key in "abc":
        pos, buf, rounds = 0, 0, 0
        for _ in range(200 if key == "a" else 30):
            pos += rng.randrange(1, 4)
            n = rng.randrange(1, 9)
            rows.append((key, pos, n))
            buf += n
            want[(key, pos)] = (rounds, buf > limit)
            if buf > limit:
                buf, rounds = 0, rounds + 1
    df = spark.createDataFrame(rows, "k string, p long, n long")
    got = threshold_resets(df, ["k"], "p", "n", limit, width).collect()
    assert {(r.k, r.p): (r["round"], r.closes) for r in got} == want


def test_summary_steps(spark):
    df = spark.createDataFrame([("b", t, 4) for t in (1, 2, 3)], "behavior_id string, arrival long, length long")
    got = sorted(r.summary_step for r in O.summary_step(df, 10).collect())
    assert got == [10, 10]  # the third trajectory's report (20) was not reached


def test_rating_by_hand(spark):
    m = spark.createDataFrame([("l", 1, 0, 1, 1.0, 0.0), ("l", 2, 1, 0, 0.0, 0.0)], "league string, seq long, slot int, opponent_slot int, final_reward double, final_group_reward double")
    got = P.elo(m).orderBy("seq").collect()
    assert (got[0].rating, got[0].opponent_rating) == (1200.5, 1199.5)
    assert got[1].rating > 1199.5 and got[1].change == pytest.approx(0.5 - 1 / (1 + 10 ** (1 / 400)))


CURRICULUM = {
    "p1": [
        P.Lesson("fake", "reward", 30, 100, False, True, "l1"),
        P.Lesson("fake", "progress", 0.5, 100, False, False, "l2"),
        P.Lesson(name="l3"),
    ]
}


def test_curriculum_golden():
    state = P.lesson_state(CURRICULUM)
    step = lambda progress, value: P.lesson_step(CURRICULUM, state, "fake", progress, value)
    for _ in range(99):
        assert step(0.1, 1000.0) == []
    assert step(0.1, -1e9) == []  # 100 returns, low mean
    state["returns"]["fake"].clear()
    for _ in range(99):
        step(0.1, 1000.0)
    assert step(0.1, 1000.0) == [("p1", 1, True)]
    assert step(0.7, 1000.0) == []  # buffers were cleared
    for _ in range(98):
        step(0.2, 0.0)
    assert step(0.7, 0.0) == [("p1", 2, False)]
    assert step(0.9, 0.0) == []
    assert P.buffer_size(CURRICULUM, "fake") == 100 and P.buffer_size(CURRICULUM, "other") == 1


def test_bad_rules():
    with pytest.raises(ValueError):
        P.Lesson("b", "progress", 1.5)
    with pytest.raises(ValueError):
        P.Lesson("b", "luck")


def test_self_play_clocks(spark):
    """Ten steps a trajectory, teams in turn. By hand: team 0 learns at even times; its 3rd trajectory passes 25 learning
    steps, so team 1 learns from time 5 on; ghosts pass 15 steps at times 3 and 10 (5 at the change counts as a swap)."""
    rows = [("b?team=%d" % (t % 2), t, 10) for t in range(12)]
    traj = P.named_teams(spark.createDataFrame(rows, "behavior_id string, arrival long, length long"))
    plan = P.SelfPlay(save_steps=15, swap_steps=15, team_change=25, window=2)
    got = P.self_play_schedule(traj, plan).orderBy("arrival").collect()
    assert [r.learning_team for r in got] == [0] * 5 + [1] * 5 + [0] * 2
    assert [r.swap for r in got] == [0, 0, 0, 0, 1, 2, 2, 2, 2, 3][:5] + [2, 2, 2, 2, 3] + [4, 4]
    assert [(r.learning_step, r.ghost_step) for r in got][:6] == [(10, 0), (10, 10), (20, 10), (20, 20), (30, 20), (40, 20)]
    assert [r.snapshots for r in got] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 3, 4, 4]
    mine, ghosts = P.learning_team_only(P.self_play_schedule(traj, plan))
    assert mine.count() + sum(r.ghost_steps for r in ghosts.collect()) // 10 == 12


def plain_clocks(rows, limits):
    """(learning team, round, swap, saved, snapshots, learning step, ghost step) of (team, length) rows, one after another."""
    s = dict.fromkeys(("round", "swap", "learned", "ghosts", "changed", "kept", "swapped"), 0)
    saved = snapshots = 1
    for team, length in rows:
        before = (s["round"] % limits.teams, s["round"], s["swap"], saved, snapshots)
        s["learned" if team == before[0] else "ghosts"] += length
        change = s["learned"] - s["changed"] > limits.change
        if change:
            s["round"], s["changed"] = s["round"] + 1, s["learned"]
        if s["learned"] - s["kept"] > limits.save:
            snapshots, s["kept"] = snapshots + 1, s["learned"]
        if change or s["ghosts"] - s["swapped"] > limits.swap:
            s["swap"], s["swapped"], saved = s["swap"] + 1, s["ghosts"], snapshots
        yield (*before, s["learned"], s["ghosts"])


@pytest.mark.parametrize("seed,teams,change,save,swap,width", [(1, 2, 60, 40, 30, 7), (2, 3, 25, 90, 11, 16), (3, 2, 5, 5, 5, 3), (4, 4, 300, 7, 200, 50), (5, 1, 20, 9, 9, 10), (6, 2, 40, 30, 25, 1 << 18)])
def test_two_clocks_in_blocks(spark, seed, teams, change, save, swap, width):
    """Blocks of any width give what a fold gives, row by row."""
    rng, limits = random.Random(seed), Limits(teams, change, save, swap)
    rows, want = [], {}
    for key, n in (("a", 400), ("b", 60), ("c", 1)):
        # Now and then a team comes alone for long, or rows bring nothing; gaps leave blocks empty.
        line, at = [], 0
        for _ in range(n):
            at += rng.choice([1, 1, 2, 40 if rng.random() < 0.05 else 1])
            line.append((key, at, rng.randrange(teams) if rng.random() < 0.8 else 0, rng.choice([0, 1, 3, 4, 4, 17])))
        rows += line
        for row, found in zip(line, plain_clocks([r[2:] for r in line], limits)):
            want[row[:2]] = found
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, arrival long, team int, length long")
    got = two_clocks(df, ["name"], ["arrival"], limits, width).collect()
    assert {(r["name"], r.arrival): tuple(r[c] for c in NUMBERED) for r in got} == want


def test_an_opponent_for_each_team(spark):
    """Three teams: two draws a swap, each for itself; the last team's counts for ratings."""
    rows = [("b", t, t % 3, 10) for t in range(60)]
    plan = P.SelfPlay(save_steps=15, swap_steps=15, team_change=45, window=3, latest_ratio=0.5, teams=3)
    df = spark.createDataFrame(rows, "name string, arrival long, team int, length long")
    draw = lambda team: (F.pmod(F.col("swap") * 7 + team * 3, F.lit(10)) / 10.0, F.pmod(F.col("swap") * 3 + team, F.lit(10)) / 10.0)
    apart = 0
    for r in P.drawn_opponents(P.self_play_schedule(df, plan), plan, draw).collect():
        assert [o.team for o in r.opponents] == [t for t in range(3) if t != r.learning_team]
        for o in r.opponents:
            latest = r.swap == 0 or (r.swap * 7 + o.team * 3) % 10 / 10 >= 0.5
            slot = -1 if latest else int((r.swap * 3 + o.team) % 10 / 10 * min(r.saved, 3))
            assert (o.plays_latest, o.slot) == (latest, slot)
            assert o.snapshot == (-1 if latest else max(n for n in range(r.saved) if n % 3 == slot))
        assert (r.slot, r.snapshot) == (r.opponents[-1].slot, r.opponents[-1].snapshot)
        apart += r.opponents[0].slot != r.opponents[1].slot
    assert apart


def test_ladder_with_group_rewards(spark):
    """The group's last reward decides where it outweighs the own one."""
    rows = [("l", 1, 1, 0, -0.5, 1.0), ("l", 2, 1, 0, 0.5, -0.5)]
    schema = "league string, seq long, snapshots long, slot long, final_reward double, final_group_reward double"
    got = P.ladder(spark.createDataFrame(rows, schema), 2, ["seq"]).orderBy("seq").collect()
    assert got[0].change == 0.5 and got[1].change == pytest.approx(0.5 - 1 / (1 + 10 ** (-1 / 400)))


def test_ladder_between_trainers(spark):
    """Strikers and goalie with trainers of their own: the opponent's slots are its own trainer's, and it loses what the learner wins."""
    rows = [("l", 1, 1, 0, 1.0, "s", "g", 1), ("l", 2, 1, -1, 1.0, "g", "s", 1), ("l", 3, 1, 0, 0.0, "s", "g", 1)]
    schema = "league string, seq long, snapshots long, slot long, final_reward double, trainer string, opponent_trainer string, opponent_snapshots long"
    got = P.ladder(spark.createDataFrame(rows, schema), 2, ["seq"]).orderBy("seq").collect()
    first = (0.5, 1200.5, 1199.5)
    won = 1 - 1 / (1 + 10 ** (0.5 / 400))
    second = (won, 1200 + won, 1200.5 - won)
    lost = 0.5 - 1 / (1 + 10 ** ((1199.5 - (1200.5 - won)) / 400))
    third = (lost, 1200.5 - won + lost, 1199.5 - lost)
    for r, want in zip(got, (first, second, third)):
        assert (r.change, r.rating, r.opponent_rating) == pytest.approx(want)


def test_ladder_by_hand(spark):
    """A win over a snapshot, a game against itself, then a snapshot that starts with the rating won."""
    rows = [("l", 1, 1, 0, 1.0), ("l", 2, 1, -1, 1.0), ("l", 3, 2, 1, -1.0)]
    got = P.ladder(spark.createDataFrame(rows, "league string, seq long, snapshots long, slot long, final_reward double"), 2, ["seq"]).orderBy("seq").collect()
    assert [(r.change, r.rating, r.opponent_rating) for r in got] == [(0.5, 1200.5, 1199.5), (0.5, 1200.5, 1200.5), (-0.5, 1200.0, 1201.0)]


def test_rated(spark):
    rows = [(1, True, False, 0), (2, False, False, 0), (3, True, True, 0), (4, True, False, 1)]
    df = spark.createDataFrame(rows, "id int, done boolean, interrupted boolean, team int").withColumn("learning_team", F.lit(0))
    assert [r.id for r in P.rated(df).collect()] == [1]
    assert [r.id for r in P.rated(df.withColumn("group_done", F.lit(False))).collect()] == []


@pytest.mark.parametrize("width", [3, 10, 1 << 18])
def test_paths_in_blocks(spark, width):
    """Walks that wander, stand still with a tremble, or jump are thinned in blocks as they are row by row."""
    rng, rows, want = random.Random(width), [], set()
    for key, step in (("walk", 0.3), ("still", 0.01), ("jump", 3.0), ("one", 0.0)):
        x = y = 0.0
        last = None
        for t in range(1 if key == "one" else 150):
            x, y = x + rng.uniform(-step, step), y + rng.uniform(-step, step)
            if key == "still" and t == 140:
                x += 5
            rows.append((key, t, x, y))
            if last is None or (x - last[0]) ** 2 + (y - last[1]) ** 2 >= 0.25:
                want.add((key, t))
                last = (x, y)
    df = spark.createDataFrame(rows, "k string, t long, x double, y double")
    got = P.path_points(df, ["k"], "t", ["x", "y"], width=width).collect()
    assert {(r.k, r.t) for r in got} == want and len(got) == len(want)


def test_path_points(spark):
    xs = [0.0, 0.3, 0.6, 0.9, 1.0, 1.1, 1.7]
    df = spark.createDataFrame([("a", t, x) for t, x in enumerate(xs)], "k string, t long, x double")
    assert [r.x for r in P.path_points(df, ["k"], "t", ["x"]).orderBy("t").collect()] == [0.0, 0.6, 1.1, 1.7]


def test_paths_side_by_side():
    """Many short paths and some long ones in one frame are thinned as each by itself, whatever frames their rows come in."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    sizes = [*rng.integers(1, 12, 300).tolist(), 64, 65, 400, 1]
    rng.shuffle(sizes)
    starts = np.cumsum([0, *sizes[:-1]])
    xy = rng.integers(0, 8, (sum(sizes), 2)) / 4.0
    xy[rng.integers(0, len(xy), 40)] = np.nan
    entries = [rng.integers(0, 8, 2).tolist() if rng.random() < 0.4 else None for _ in sizes]
    got = np.flatnonzero(P.kept_rows(xy, starts, entries, 0.5)).tolist()
    want = [a + j for a, n, e in zip(starts.tolist(), sizes, entries) for j in P.kept_points(xy[a : a + n], None if e is None else np.asarray(e, float), 0.5)]
    assert got == want
    pdf = pd.DataFrame({"k": np.repeat(np.arange(len(sizes)), sizes), "n": np.arange(len(xy))})
    frames = [*P.whole_runs((pdf.iloc[i : i + 7] for i in range(0, len(pdf), 7)), ["k"])]
    assert [x for f, _ in frames for x in f["n"]] == pdf["n"].tolist()
    assert [n for f, s in frames for n in np.diff([*s, len(f)])] == sizes


def test_blocks_of_one_name_are_numbered_in_several_tasks(spark):
    rows = [("all", a, "b", 0, a % 5, 0, 0, a % 2, 1 + a % 7) for a in range(400)]
    traj = spark.createDataFrame(rows, "name string, arrival long, behavior_id string, worker_id int, agent_id long, episode long, segment long, team int, length long")
    out = P.self_play_schedule(traj, P.SelfPlay(40, 30, 60), width=16).withColumn("task", F.spark_partition_id())
    assert out.select("task").distinct().count() > 1 and out.count() == 400


def test_short_names_are_numbered_in_one_pass(spark):
    """Names of few rows take one pass, beside one of many rows that goes by blocks; columns to keep stay with their rows, in whatever frames they come."""
    rng, limits = random.Random(11), Limits(2, 25, 9, 14)
    rows, want = [], {}
    for key, n in (("long", 700), *((f"n{i}", rng.randrange(1, 60)) for i in range(9))):
        line = [(key, at, rng.randrange(2), rng.choice([0, 1, 4, 17]), f"{key} {at}") for at in range(n)]
        rows += line
        for row, found in zip(line, plain_clocks([r[2:4] for r in line], limits)):
            want[row[4]] = found
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, arrival long, team int, length long, kept string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        got = two_clocks(df, ["name"], ["arrival"], limits, 16, ("kept",)).collect()
        short = two_clocks(df.filter("name <> 'long'"), ["name"], ["arrival"], limits, 16)
        assert short.count() == sum(r[0] != "long" for r in rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.kept: tuple(r[c] for c in NUMBERED) for r in got} == want and len(got) == len(want)
    assert all(r.kept == f"{r['name']} {r.arrival}" for r in got)
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan and "Join" not in plan
