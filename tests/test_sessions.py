"""Golden sequences and returns."""

import random

import pytest
from pyspark.sql import functions as F

from episodica.operators import replay as B
from episodica.operators import returns as R
from episodica.operators import sessions as S

EXP = (
    "behavior_id string, worker_id int, agent_id long, episode long, segment long, i long, j long, "
    "reward double, value_est double, next_value double, done boolean, interrupted boolean"
)


def traj(rewards, values, next_value, done=False, interrupted=False, agent=1):
    n = len(rewards)
    nexts = [*values[1:], next_value]
    return [
        ("b", 0, agent, 0, 0, t, t, rewards[t], values[t], nexts[t], done and t == n - 1, interrupted and t == n - 1)
        for t in range(n)
    ]


def test_gae_and_return_by_hand(spark):
    exp = R.bootstrap(spark.createDataFrame(traj([1.0, 1.0], [0.0, 0.0], 0.0), EXP))
    got = [r.advantage for r in R.gae(exp, 0.99, 0.95, 10).orderBy("i").collect()]
    assert got == pytest.approx([1.9405, 1.0])
    exp = R.bootstrap(spark.createDataFrame(traj([1.0] * 3, [0.0] * 3, 0.0), EXP))
    got = [r.discounted_return for r in R.discounted_returns(exp, 0.5, 10).orderBy("i").collect()]
    assert got == pytest.approx([1.75, 1.5, 1.0])


@pytest.mark.parametrize("gamma,lam,horizon", [(0.99, 0.95, 64), (0.0, 0.95, 64), (0.9, 0.0, 64), (1.0, 1.0, 64), (0.5, 0.5, 4000)])
def test_recurrences_against_loops(spark, gamma, lam, horizon):
    rng = random.Random(1)
    rows, want = [], {}
    for agent in range(6):
        n = rng.randrange(1, 40)
        r, v = [rng.gauss(0, 1) for _ in range(n)], [rng.gauss(0, 1) for _ in range(n)]
        nv, done, cut = rng.gauss(0, 1), agent % 2 == 0, agent % 3 == 0
        rows += traj(r, v, nv, done, done and cut, agent)
        boot = 0.0 if done and not cut else nv
        adv = ret = 0.0
        lam_ret = None
        ret = boot
        for t in reversed(range(n)):
            vn = v[t + 1] if t + 1 < n else boot
            adv = r[t] + gamma * vn - v[t] + gamma * lam * adv
            ret = r[t] + gamma * ret
            lam_ret = r[t] + gamma * vn if lam_ret is None else r[t] + gamma * lam * lam_ret + gamma * (1 - lam) * vn
            want[(agent, t)] = (adv, ret, lam_ret)
    exp = R.bootstrap(spark.createDataFrame(rows, EXP))
    out = R.lambda_return(R.discounted_returns(R.gae(exp, gamma, lam, horizon), gamma, horizon), gamma, lam, horizon)
    for g in out.collect():
        assert (g.advantage, g.discounted_return, g.lambda_return) == pytest.approx(want[(g.agent_id, g.i)], abs=1e-9)


def test_bootstrap_ends(spark):
    rows = traj([1.0], [0.0], 5.0, True, False, 1) + traj([1.0], [0.0], 5.0, True, True, 2) + traj([1.0], [0.0], 5.0, False, False, 3)
    exp = spark.createDataFrame(rows, EXP)
    assert {r.agent_id: r.v_next for r in R.bootstrap(exp).collect()} == {1: 0.0, 2: 5.0, 3: 5.0}
    assert {r.v_next for r in R.bootstrap(exp, ignore_done=True).collect()} == {5.0}
    group = R.group_bootstrap(exp.withColumn("group_done", F.col("agent_id") == 1))
    assert {r.agent_id: r.group_v_next for r in group.collect()} == {1: 0.0, 2: 5.0, 3: 5.0}
    half_dead = R.group_bootstrap(exp.withColumn("group_done", F.lit(False)))
    assert {r.group_v_next for r in half_dead.collect()} == {5.0}


def nine(spark, agents=(2,)):
    rows = [("b", 0, a, 0, 0, s, s, 200.0 + 10 * s + 1) for a in agents for s in range(9)]
    return spark.createDataFrame(rows, EXP.split(", value_est")[0].replace("reward", "obs"))


def test_sequences_golden(spark):
    one = nine(spark)
    last = B.last_sequences(one.drop("j"), 2, 3, position="i")
    assert sorted(r.i for r in last.collect()) == [3, 4, 5, 6, 7, 8]
    slide = S.sliding_sequences(one, 3, "i").orderBy("seq").collect()
    assert [r.window for r in slide][-2:] == [[5, 6, 7], [6, 7, 8]]
    padded = S.resequence(one, 4, {"obs": 0.0}).orderBy("seq", "pos").collect()
    assert len(padded) == 12 and [r.obs for r in padded[9:]] == [0.0] * 3 and [r["mask"] for r in padded[8:]] == [1, 0, 0, 0]
    assert S.resequence(nine(spark, (2, 3)), 2, {"obs": 0.0}).count() == 20


def test_padding_repeats_last_times_factor(spark):
    df = nine(spark).withColumn("m", F.lit(3)).withColumn("g", F.array(F.lit(1.0)))
    out = S.resequence(df, 5, {"obs": 0.0, "m": 1.0, "g": 0.0}).filter("mask = 0").collect()
    assert [(r.obs, r.m, r.g) for r in out] == [(0.0, 3, [])]


def test_truncation(spark):
    df = nine(spark).drop("j")
    assert B.truncate_replay(df, 9, 1, "i").count() == 9
    kept = B.truncate_replay(df, 5, 3, "i").collect()
    assert sorted(r.i for r in kept) == [6, 7, 8]  # int(0.8 * 5) = 4, less 1 for whole sequences


def test_masked_mean(spark):
    df = spark.createDataFrame([(float(x), x >= 3) for x in range(1, 6)], "x double, m boolean")
    mean = lambda m: df.agg(B.masked_mean("x", m).alias("v")).first().v
    assert (mean(F.lit(True)), mean("m"), mean(F.lit(False))) == (3.0, 4.0, 0.0)


def test_normaliser_by_hand_and_loop(spark):
    df = spark.createDataFrame([("b", [1.0, 2.0])], "behavior_id string, obs array<double>")
    r = B.fit_normalizer(df, "obs", 2).first()
    assert (r.steps, r["mean"][0], r.m2[0]) == (2, 0.5, 1.5)
    xs = [random.Random(2).gauss(3, 2) for _ in range(50)]
    steps, mean, m2 = 1, 0.0, 1.0
    for x in xs:
        steps += 1
        delta = x - mean
        mean += delta / steps
        m2 += delta * (x - mean)
    df = spark.createDataFrame([("b", [x]) for x in xs], "behavior_id string, obs array<double>")
    r = B.fit_normalizer(df, "obs", 1).first()
    assert (r.steps, r["mean"][0], r.m2[0]) == pytest.approx((steps, mean, m2))


def test_experience_shift_and_segments(spark):
    rows = [("b", 0, 1, t, t == 5, False, float(t)) for t in range(6)] + [("b", 0, 1, t, False, False, float(t)) for t in (6, 7)]
    df = spark.createDataFrame(rows, "behavior_id string, worker_id int, agent_id long, tick long, is_terminal boolean, interrupted boolean, reward double")
    exp = S.to_experiences(df, 3)
    got = [(r.tick, r.reward, r.done, r.segment, r.j, r.episode) for r in exp.orderBy("tick").collect()]
    assert got == [(0, 1.0, False, 0, 0, 0), (1, 2.0, False, 0, 1, 0), (2, 3.0, False, 0, 2, 0), (3, 4.0, False, 1, 0, 0),
                   (4, 5.0, True, 1, 1, 0), (6, 7.0, False, 0, 0, 1)]
    ep = S.episode_summary(exp).collect()
    assert [(e.episode_return, e.episode_length, e.n_experiences) for e in ep] == [(15.0, 4, 5)]
    assert S.trajectories(exp, 3).count() == 2


def test_hybrid_actions_keep_their_shape(spark):
    rows = [("b", 0, 1, t, False, False, 0.0, ([float(t + 1)], [t, 2])) for t in range(4)]
    df = spark.createDataFrame(rows, "behavior_id string, worker_id int, agent_id long, tick long, is_terminal boolean, interrupted boolean, reward double, action struct<continuous: array<float>, discrete: array<int>>")
    exp = S.to_experiences(df, 2, behind=["action"]).drop("next_action")
    got = S.with_prev_action(S.with_next(exp, mate_action="action")).orderBy("tick").collect()
    flat = lambda a: (list(a.continuous), list(a.discrete))
    assert [flat(r.next_action) for r in got] == [([2.0], [1, 2]), ([0.0], [0, 0]), ([0.0], [0, 0])]
    assert [flat(r.next_mate_action) for r in got] == [([2.0], [1, 2]), ([2.0], [1, 2]), ([3.0], [2, 2])]
    assert [flat(r.prev_action) for r in got] == [([0.0], [0, 0]), ([1.0], [0, 2]), ([2.0], [1, 2])]
