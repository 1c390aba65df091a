"""Blocked orders give the same answer at every block width, one hot key included."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from episodica.functions.numbers import spread_key
from episodica.operators import replay as B
from episodica.operators import selfplay as P
from episodica.operators import sessions as S
from episodica.operators import stats as O
from episodica.plans.lineage import join_stats
from episodica.plans.ordered import fill_forward, prefix, with_halo


def plain_spread(x, seed=0):
    def mix(v):
        for _ in range(2):
            v = (v ^ v >> 16) * 73244475 % 2**32
        return v ^ v >> 16

    return mix((x & 0xFFFFFFFF) ^ (x >> 32 & 0xFFFFFFFF) ^ mix(seed))


def test_spread_keys(spark):
    ids = [0, 1, 2**31, 2**40 + 7, 2**62, -5]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", spread_key("id", 3).alias("k")).collect()
    assert [r.k for r in got] == [plain_spread(i, 3) for i in ids]


def test_seeds_shuffle_apart(spark):
    def pairs(seed):
        order = [r[0] for r in spark.range(400).orderBy(spread_key("id", seed)).collect()]
        return set(zip(order, order[1:]))

    assert len(pairs(1) & pairs(2)) < 8


def test_shared_ticks_have_one_order(spark):
    """Twelve agents that close ten steps on each of six ticks: 72 trajectories, 720 steps, one order."""
    rows = [("b", 0, agent, tick, 0, 10, tick, True) for tick in range(6) for agent in range(12)]
    traj = spark.createDataFrame(rows, "behavior_id string, worker_id int, agent_id long, episode long, segment long, length long, arrival long, done boolean")
    for width in (1, 3, 1 << 18):
        steps = {(r.arrival, r.agent_id): r.trainer_step for r in O.with_trainer_step(traj, width=width).collect()}
        assert steps == {(t, a): 10 * (12 * t + a + 1) for t in range(6) for a in range(12)}
        rounds = O.update_rounds(traj, 25, width=width)
        got = {(r.arrival, r.agent_id): (r.round, r.closes) for r in rounds.collect()}
        assert got == {(t, a): ((12 * t + a) // 3, (12 * t + a) % 3 == 2) for t in range(6) for a in range(12)}
        named = traj.withColumn("name", F.lit("b")).withColumn("team", (F.col("agent_id") % 2).cast("int"))
        _, ghosts = P.learning_team_only(P.self_play_schedule(named, P.SelfPlay(100, 100, 100)))
        assert sum(r.learning_steps + r.ghost_steps for r in ghosts.collect()) == 720


def log(seed=3, n=400):
    """A third of the rows belong to one agent; terminal and restart may share a tick."""
    rng = random.Random(seed)
    rows, tick, used = [], dict.fromkeys(range(8), 0), set()
    for _ in range(n):
        a = 0 if rng.random() < 0.34 else rng.randrange(1, 8)
        tick[a] += rng.randrange(1, 9)
        terminal = rng.random() < 0.2
        rows.append(("b", 0, a, tick[a], terminal, terminal and rng.random() < 0.5, rng.random()))
        if terminal and rng.random() < 0.5:
            rows.append(("b", 0, a, tick[a], False, False, rng.random()))
    return rows


SCHEMA = "behavior_id string, worker_id int, agent_id long, tick long, is_terminal boolean, interrupted boolean, reward double"


def loop(rows):
    """Episode, position, next and previous reward by walking each agent's rows."""
    out = {}
    agents = {}
    for r in sorted(rows, key=lambda r: (r[3], not r[4])):
        agents.setdefault(r[2], []).append(r)
    for a, rs in agents.items():
        episode, i = 0, 0
        for n, r in enumerate(rs):
            nxt = None if r[4] or n + 1 == len(rs) else rs[n + 1][6]
            prv = rs[n - 1][6] if i > 0 else None
            out[(a, r[3], r[4])] = (episode, i, nxt, prv)
            episode, i = (episode + 1, 0) if r[4] else (episode, i + 1)
    return out


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 18])
def test_sequenced(spark, width):
    rows = log()
    df = spark.createDataFrame(rows, SCHEMA)
    got = S.sequenced(df, ahead=["reward"], behind=["reward"], width=width).collect()
    want = loop(rows)
    assert len(got) == len(rows)
    for g in got:
        n = g.nxt.reward if g.nxt else None
        p = g.prv.reward if g.prv else None
        assert (g.episode, g.i, n, p) == want[(g.agent_id, g.tick, g.is_terminal)]


@pytest.mark.parametrize("width", [1, 10, 1 << 18])
def test_prefix_and_fill(spark, width):
    rows = [(k, p, float(p) if p % 3 == 0 else None) for k in "ab" for p in range(0, 60, 2 if k == "a" else 5)]
    df = spark.createDataFrame(rows, "k string, p long, v double")
    sums = prefix(df, ["k"], "p", {"s": F.coalesce("v", F.lit(0.0)), "n": F.lit(1)}, width=width)
    excl = prefix(df, ["k"], "p", {"e": F.lit(1)}, inclusive=False, width=width)
    filled = fill_forward(df, ["k"], "p", {"f": F.col("v")}, width=width)
    for k in "ab":
        run, n, last = 0.0, 0, None
        s = {r.p: (r.s, r.n) for r in sums.filter(F.col("k") == k).collect()}
        e = {r.p: r.e for r in excl.filter(F.col("k") == k).collect()}
        f = {r.p: r.f for r in filled.filter(F.col("k") == k).collect()}
        for _, p, v in sorted(r for r in rows if r[0] == k):
            assert e[p] == n
            run, n, last = run + (v or 0.0), n + 1, v if v is not None else last
            assert s[p] == (run, n) and f[p] == last


@pytest.mark.parametrize("width", [5, 8, 1 << 18])
def test_halo_frame(spark, width):
    df = spark.range(57).select(F.lit("k").alias("k"), F.col("id").alias("rank"))
    spread, part = with_halo(df, ["k"], "rank", 4, width)
    w = Window.partitionBy(*part).orderBy("rank").rowsBetween(-4, 0)
    got = spread.withColumn("s", F.sum("rank").over(w)).filter("NOT _halo").collect()
    assert len(got) == 57
    for r in got:
        assert r.s == sum(range(max(0, r.rank - 4), r.rank + 1))


def test_shuffle_is_a_permutation_of_sequences(spark):
    df = spark.range(503).select(F.lit("b").alias("behavior_id"), F.col("id").alias("tick"))
    ranked = B.with_rank(df, "tick", width=50)
    got = {r.tick: r.shuffled for r in B.shuffle_sequences(ranked, 5, 9).collect()}
    order = sorted(range(100), key=lambda q: plain_spread(q, 9))
    assert got == {q * 5 + p: n * 5 + p for n, q in enumerate(order) for p in range(5)}
    assert B.minibatches(B.shuffle_sequences(ranked, 5, 9), 23, 5).count() == 500


def test_stats_join(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    stats = rows.groupBy("k").agg(F.max("id").alias("m"))
    for salts in (1, 4):
        out = join_stats(rows, stats, ["k"], salts=salts)
        assert out.count() == 300 and {(r.k, r.m) for r in out.collect()} == {(0, 297), (1, 298), (2, 299)}


@pytest.mark.parametrize("width", [3, 1 << 18])
def test_rolling_and_stacking(spark, width):
    eps = spark.createDataFrame([("b", t, float(t % 7)) for t in range(0, 80, 2)], "behavior_id string, end_tick long, episode_return double")
    got = S.rolling_returns(eps, 4, width).orderBy("rank").collect()
    vals = [float(t % 7) for t in range(0, 80, 2)]
    for n, r in enumerate(got):
        part = vals[max(0, n - 3) : n + 1]
        assert r.rolling_return == pytest.approx(sum(part) / len(part)) and r.n_in_buffer == len(part)


def test_stacking_golden(spark):
    rows = [("b", 0, 1, 0, n, [2 * n + 1, 2 * n + 2]) for n in range(4)]
    df = spark.createDataFrame(rows, "behavior_id string, worker_id int, agent_id long, episode long, i long, obs array<int>")
    for width in (2, 100):
        got = [r.stacked for r in S.stack_obs(df, 3, size=2, width=width).orderBy("i").collect()]
        assert got == [[0, 0, 0, 0, 1, 2], [0, 0, 1, 2, 3, 4], [1, 2, 3, 4, 5, 6], [3, 4, 5, 6, 7, 8]]


def test_reward_since_decision(spark):
    rows = [("b", 0, 1, t, op, v, d) for t, op, v, d in [
        (0, "add", 1.0, False), (1, "add", 2.0, True), (2, "add", 5.0, False), (3, "set", 1.0, False),
        (4, "add", 0.5, True), (5, "add", 9.0, False)]]
    df = spark.createDataFrame(rows, "behavior_id string, worker_id int, agent_id long, tick long, op string, amount double, is_decision boolean")
    for width in (2, 1 << 18):
        got = {(r.decision, r.closed): r.reward for r in S.reward_since_decision(df, width).collect()}
        assert got == {(0, 1): 3.0, (1, 1): 1.5, (2, 0): 9.0}
