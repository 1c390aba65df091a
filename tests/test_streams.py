"""Streams over several micro-batches give what their batch twins give on the same rows."""

import random

import pytest

from episodica.operators import selfplay as P
from episodica.operators import sessions as S
from episodica.streaming import agents, folds
from episodica.streaming import stats as SS
from episodica.streaming.sources import run_available, run_batches, stream_steps

SCHEMA = "behavior_id string, worker_id int, agent_id long, tick long, is_terminal boolean, interrupted boolean, reward double, k long, is_reset boolean"


def rows(seed=4, n=240):
    rng = random.Random(seed)
    return [("b", 0, rng.randrange(5), t, rng.random() < 0.15, False, rng.random(), t % 17, False) for t in range(n)]


def files(spark, path, data, schema, parts=4, order=3):
    """One file per span of the order column, oldest first."""
    data = sorted(data, key=lambda r: r[order])
    step = -(-len(data) // parts)
    for n in range(parts):
        spark.createDataFrame(data[n * step : (n + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(path))
    return stream_steps(spark, str(path), schema=spark.createDataFrame([], schema).schema, per_trigger=1)


def test_trajectories(spark, tmp_path):
    data = rows()
    live = files(spark, tmp_path / "in", data, SCHEMA)
    got = run_available(agents.stream_trajectories(live.drop("is_reset"), 4, {"k": "long"}))
    batch = S.to_experiences(spark.createDataFrame(data, SCHEMA).drop("is_reset").withColumnRenamed("k", "obs"), 4)
    closed = S.trajectories(batch, 4).select("agent_id", "episode", "segment")
    want = batch.join(closed, ["agent_id", "episode", "segment"])
    cols = ["agent_id", "episode", "segment", "i", "tick", "next_tick", "done"]
    a = sorted((*[r[c] for c in cols], r.k, r.next_k, r.reward) for r in got.collect())
    b = sorted((*[r[c] for c in cols], r.obs, r.next_obs, r.reward) for r in want.collect())
    assert a == b and len(a) > 100


def test_reset_drops_open_rows(spark, tmp_path):
    base = [("b", 0, 1, t, False, False, 1.0, t, False) for t in range(3)]
    base += [("b", 0, 1, 3, False, False, 0.0, 0, True)]
    base += [("b", 0, 1, t, t == 6, False, 1.0, t, False) for t in range(4, 7)]
    live = files(spark, tmp_path / "in", base, SCHEMA, parts=2)
    got = run_available(agents.stream_trajectories(live, 10)).collect()
    assert sorted((r.tick, r.episode, r.done) for r in got) == [(4, 1, False), (5, 1, True)]


def test_state_may_expire(spark, tmp_path):
    data = rows(5, 60)
    files(spark, tmp_path / "in", data, SCHEMA, parts=1)
    live = stream_steps(spark, str(tmp_path / "in"), schema=spark.createDataFrame([], SCHEMA).schema)
    stream = agents.stream_trajectories(live.drop("is_reset"), 4, ttl_ms=3_600_000)
    # A plan with processing time always has a next batch: run a single one.
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True)
    q = q.start(str(tmp_path / "out"))
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()
    assert spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).count() > 0


def test_episode_returns(spark, tmp_path):
    data = rows(9)
    live = files(spark, tmp_path / "in", data, SCHEMA)
    got = run_available(agents.stream_episode_returns(live.drop("is_reset")))
    want = S.episode_summary(S.to_experiences(spark.createDataFrame(data, SCHEMA).drop("is_reset", "k"), 64))
    key = lambda r: (r.agent_id, r.episode)
    g, w = {key(r): r for r in got.collect()}, {key(r): r for r in want.collect()}
    assert set(g) == set(w)
    for k in g:
        assert g[k].episode_return == pytest.approx(w[k].episode_return) and g[k].episode_length == w[k].episode_length


def test_lessons_and_ratings(spark, tmp_path):
    rng = random.Random(8)
    cur = {"p": [P.Lesson("b", "reward", 0.55, 4, True), P.Lesson("b", "progress", 0.5, 2, False), P.Lesson()]}
    evals = [(f"r{n % 3}", n, "b", n / 300, rng.random() if n % 4 else None) for n in range(300)]
    schema = "run string, seq long, behavior string, progress double, episode_return double"
    live = files(spark, tmp_path / "e", evals, schema, order=1)
    got = sorted(map(tuple, run_available(folds.stream_lessons(live, cur)).collect()))
    assert got == sorted(map(tuple, P.lesson_progress(spark.createDataFrame(evals, schema), cur).collect())) and got
    ms = [("a", n, rng.randrange(3), 3 + rng.randrange(3), rng.choice([-1.0, 0.0, 1.0]), 0.0) for n in range(200)]
    schema = "league string, seq long, slot int, opponent_slot int, final_reward double, final_group_reward double"
    live = files(spark, tmp_path / "m", ms, schema, order=1)
    got = {r.seq: r.rating for r in run_available(folds.stream_elo(live, 16.0)).collect()}
    want = {r.seq: r.rating for r in P.elo(spark.createDataFrame(ms, schema), 16.0).collect()}
    assert got == pytest.approx(want)


def test_replay_store_compacts(spark, tmp_path):
    data = [("b", t, t) for t in range(60)]
    live = files(spark, tmp_path / "in", data, "behavior_id string, tick long, k long", parts=6, order=1)
    path = str(tmp_path / "store")
    run_batches(live, SS.replay_writer(path, 25, 5, every=3))
    got = sorted(r.tick for r in SS.load_stream_replay(spark, path).collect())
    assert got == list(range(20, 60))  # newest 20 of the first four batches, then two more batches


def test_a_workers_reset_reaches_its_agents(spark, tmp_path):
    """Worker 0 is reset between two batches: both its agents lose what they had open, worker 1's goes on."""
    data = [("b", w, a, t, False, False, 1.0, t, False) for t in range(12) for w, a in ((0, 1), (0, 2), (1, 3))]
    live = files(spark, tmp_path / "in", data, SCHEMA, parts=2)
    resets = spark.createDataFrame([(0, 6)], "worker_id int, tick long")
    got = run_available(agents.stream_trajectories(agents.with_epoch(live.drop("is_reset"), resets), 4)).collect()
    by_agent = {a: sorted((r.episode, r.tick) for r in got if r.agent_id == a) for a in (1, 2, 3)}
    assert by_agent[1] == by_agent[2] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 6), (1, 7), (1, 8), (1, 9)]
    assert by_agent[3] == [(0, t) for t in range(8)]


def test_ladder_on_a_stream(spark, tmp_path):
    rng = random.Random(11)
    rows = [("l%d" % (n % 2), n, 1 + n // 15, rng.randrange(-1, min(1 + n // 15, 3)), rng.choice([-1.0, 0.0, 1.0]), 0.25) for n in range(160)]
    schema = "league string, seq long, snapshots long, slot long, final_reward double, final_group_reward double"
    live = files(spark, tmp_path / "in", rows, schema, order=1)
    got = {(r.league, r.seq): (r.change, r.rating, r.opponent_rating) for r in run_available(folds.stream_ladder(live, 3, 8.0)).collect()}
    batch = P.ladder(spark.createDataFrame(rows, schema), 3, ["seq"], 8.0)
    want = {(r.league, r.seq): (r.change, r.rating, r.opponent_rating) for r in batch.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
