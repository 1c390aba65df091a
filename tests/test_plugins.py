"""User code in parts and in lockstep, beside the same code over whole groups and single rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions.numbers import spread_uniform
from episodica.operators import plugins as X


def test_processor_in_parts(spark):
    """Three groups, one of them most of the rows, one with a null key: parts merge to what the whole group gives."""
    rng = random.Random(2)
    rows = [("a" if n % 9 else "b" if n % 2 else None, n % 3, rng.random()) for n in range(5000)]
    df = spark.createDataFrame(rows, "k string, j int, reward double").repartition(7)
    p = X.Processor(
        start=lambda: np.zeros(3),
        update=lambda s, v: s + [v.sum(), (v * v).sum(), len(v)],
        merge=lambda a, b: a + b,
        finish=lambda s: s[1] / s[2] - (s[0] / s[2]) ** 2,
    )
    got = {r.k: r.reward for r in X.processed(df, ["k"], "reward", p).collect()}
    for key in ("a", "b", None):
        assert got[key] == pytest.approx(np.var([r[2] for r in rows if r[0] == key]))
    assert len(got) == 3 and X.processed(df.limit(0), ["k"], "reward", p).count() == 0


def test_recurrent_policy_in_lockstep(spark):
    """Agents of very different length get the actions that a cell gives them one row at a time."""
    rng = random.Random(4)
    rows = [("b", a, t, [rng.random(), rng.random()]) for a in range(40) for t in range(rng.randrange(1, 60 if a else 400))]
    w = np.array([[0.5, -0.2, 0.1], [0.3, 0.4, -0.6]])

    def cell(x, memory):
        memory = np.tanh(x @ w + 0.5 * memory)
        return memory.argmax(axis=1), memory

    df = spark.createDataFrame(rows, "behavior_id string, agent_id long, tick long, obs array<double>").repartition(5)
    got = X.score_recurrent(df, ["behavior_id", "agent_id"], "tick", "obs", 3, cell, [], width=16).collect()
    want = {}
    for a in range(40):
        memory = np.zeros((1, 3))
        for _, _, t, x in sorted(r for r in rows if r[1] == a):
            action, memory = cell(np.array([x]), memory)
            want[(a, t)] = int(action[0])
    assert {(r.agent_id, r.tick): r.action for r in got} == want


def test_spread_uniform(spark):
    df = spark.range(20_000).select(spread_uniform(F.lit(7), "id", seed=3).alias("u"), spread_uniform(F.lit(8), "id", seed=3).alias("v"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.corr("u", "v"), F.countDistinct("u")).first()
    assert 0 <= r[0] and r[1] < 1 and r[2] == pytest.approx(0.5, abs=0.01) and abs(r[3]) < 0.03 and r[4] > 19_900
