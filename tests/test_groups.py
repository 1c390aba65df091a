"""Group status against a literal walk through the ticks, with agents sharing ticks."""

import random

import pytest
from pyspark.sql import functions as F

from episodica.operators import groups as G

SCHEMA = (
    "behavior_id string, worker_id int, agent_id long, group_id int, tick long, is_terminal boolean, "
    "interrupted boolean, reward double, group_reward double, k long"
)


def world(seed, ticks=60, agents=9):
    rng = random.Random(seed)
    rows = []
    for t in range(ticks):
        for a in range(agents):
            if rng.random() < 0.4:
                terminal = rng.random() < 0.25
                rows.append(("b", 0, a, a % 3, t, terminal, False, rng.randrange(-9, 9) / 4, 1.0, rng.randrange(100)))
                if terminal and rng.random() < 0.5:
                    rows.append(("b", 0, a, a % 3, t, False, False, 0.25, 1.0, rng.randrange(100)))
    return rows


def walk(rows):
    """(agent, tick, terminal) -> sorted mates' (agent, previous k, reward, done)."""
    out, last, status = {}, {}, {}
    for t in sorted({r[4] for r in rows}):
        now = [r for r in rows if r[4] == t]
        ended = [r for r in now if r[5]]
        for phase in (ended, [r for r in now if not r[5]]):
            for r in phase:
                if r[2] in last and r[3] > 0:
                    status.setdefault(r[3], {})[r[2]] = (last[r[2]][9], r[7], r[5])
            for r in phase:
                if r[2] in last:
                    mates = {a: s for a, s in status.get(r[3], {}).items() if a != r[2]} if r[3] > 0 else {}
                    out[(r[2], t, r[5])] = sorted((a, *s) for a, s in mates.items())
                if r[5]:
                    last.pop(r[2], None)
                else:
                    last[r[2]] = r
        for r in ended:
            status.get(r[3], {}).pop(r[2], None)
    return out


@pytest.mark.parametrize("seed,width", [(1, 4), (2, 16), (3, 1 << 18), (4, 1)])
def test_against_walk(spark, seed, width):
    rows = world(seed)
    want = walk(rows)
    st = G.statuses(spark.createDataFrame(rows, SCHEMA), width).withColumn("prev_k", F.col("prv.k"))
    lists = G.group_status(st, ["prev_k", "reward", "is_terminal"]).collect()
    assert len(lists) == len(want)
    for r in lists:
        got = sorted(tuple(m) for m in r.group_status)
        assert got == want[(r.agent_id, r.tick, r.is_terminal)], (r.agent_id, r.tick)
    for r in G.group_totals(st, width).collect():
        mates = want[(r.agent_id, r.tick, r.is_terminal)]
        assert r.n_mates == len(mates) and r.n_done_mates == sum(m[3] for m in mates)
        assert r.mates_reward == pytest.approx(sum(m[2] for m in mates))
        assert r.group_done == all(m[3] for m in mates)


@pytest.mark.parametrize("seed,width", [(1, 3), (2, 1 << 18)])
def test_group_rewards_reach_decisions(spark, seed, width):
    """Every decision receives what its group was given since the agent's last one; a `set` forgets what came before it."""
    rng = random.Random(seed)
    rewards = [(g, t, rng.choice(["add", "add", "set"]), float(rng.randrange(-5, 9))) for g in (1, 2) for t in range(60) if rng.random() < 0.4]
    decisions = [(1 + a % 2, a, t) for a in range(5) for t in range(60) if rng.random() < (0.3 if a else 0.05)]
    got = G.broadcast_group_reward(
        spark.createDataFrame(rewards, "group_id int, tick long, op string, amount double"),
        spark.createDataFrame(decisions, "group_id int, agent_id long, tick long"), width,
    ).collect()
    want, last = {}, {}
    for g, a, t in sorted(decisions, key=lambda d: d[2]):
        total = 0.0
        for _, _, op, x in sorted((r for r in rewards if r[0] == g and last.get(a, -1) < r[1] <= t), key=lambda r: r[1]):
            total = x if op == "set" else total + x
        want[(a, t)], last[a] = total, t
    assert {(r.agent_id, r.tick): r.group_reward for r in got} == pytest.approx(want) and len(got) == len(want)


def test_interval_levels(spark):
    """An interval touches one or two buckets of its level; the longest ones have a level too."""
    rows = [(f, f + n) for f in (0, 1, 63, 64, 1000, 4095) for n in (1, 2, 4, 5, 16, 17, 1000)] + [(5, 1 << 62)]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("level", G.level_of(F.col("b") - F.col("a")))
    for r in df.select("*", G.bucket(F.col("a"), F.col("level")).alias("x"), G.bucket(F.col("b") - 1, F.col("level")).alias("y")).collect():
        assert 0 <= r.y - r.x <= 1 and 4**r.level >= r.b - r.a


def test_lists_of_blocks_grow_with_the_rows(spark):
    """Agents that stay silent stand in as many blocks as there are rows for them, however long the log and large the group."""
    per_row = []
    for agents in (40, 160):
        rows = [("b", 0, a, 1, t * agents + a, False, False, 0.0, 0.0, a) for a in range(agents) for t in range(2)]
        rows += [("b", 0, 0, 1, 2 * agents + t, t % 50 == 0, False, 0.0, 0.0, t) for t in range(20 * agents)]
        st = G.statuses(spark.createDataFrame(rows, SCHEMA))
        where = G.blocks_of_ticks(st)
        blocks = where.agg(F.max("_end") + 1).first()[0]
        per_row.append(blocks * agents / st.count())
        met = G.with_mates(st, ["k"])
        assert met.count() == st.count() and "_all" not in met.columns
        assert met.agg(F.max(F.size("group_status"))).first()[0] == agents - 1
        plan = met._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and plan.index("group_status") < plan.index("RepartitionByExpression")
    assert max(per_row) < 3


@pytest.mark.parametrize("seed,batch", [(5, 7), (6, 10_000)])
def test_lists_in_many_blocks(spark, monkeypatch, seed, batch):
    """Blocks and frames of any size give the lists of the walk, and `reduced` gets the same lists; silent agents last over many blocks."""
    monkeypatch.setattr(G, "FEWEST", 8)
    monkeypatch.setattr(G, "CARRIED", 0.01)
    rows = world(seed, ticks=150, agents=12)
    rows += [("b", 0, a, a % 3, t, False, False, 0.5, 1.0, a) for a in (90, 91) for t in (1, 2)] + [("b", 0, 92, -1, t, False, False, 0.5, 1.0, 3) for t in (5, 6)]
    want = walk(rows)
    st = G.statuses(spark.createDataFrame(rows, SCHEMA)).withColumn("prev_k", F.col("prv.k"))
    assert G.blocks_of_ticks(st.filter("group_id > 0")).agg(F.max("_end")).first()[0] > 5

    def totals(lists):
        return {"n": lists.value_lengths().cast("int64"), "sum_k": G.sums(lists, lists.values.field("prev_k"))}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        lists = G.group_status(st, ["prev_k", "reward", "is_terminal"]).collect()
        reduced = G.group_status(st, ["prev_k"], (totals, "n long, sum_k long")).collect()
        ends = G.next_group_obs(st, 3, "k").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(lists) == len(reduced) == len(want)
    for r in lists:
        assert [tuple(m) for m in r.group_status] == want[(r.agent_id, r.tick, r.is_terminal)]
    for r in reduced:
        mates = want[(r.agent_id, r.tick, r.is_terminal)]
        assert (r.n, r.sum_k) == (len(mates), sum(m[1] for m in mates))
    due = st.filter("group_id > 0 and (is_terminal or (i - 1) % 3 = 2)").collect()
    got = {(r.agent_id, r.ord): [m.agent_id for m in r.next_group_obs] for r in ends}
    assert got == {(r.agent_id, r.ord): [m[0] for m in want[(r.agent_id, r.tick, r.is_terminal)]] for r in due} and len(ends) == len(due)


def test_a_null_among_mates_makes_their_sum_null(spark):
    rows = [("b", 0, a, 1, t, False, False, None if a == 2 else 0.5, 0.0, a) for a in (1, 2, 3) for t in (3 * a, 3 * a + 1)]
    st = G.statuses(spark.createDataFrame(rows, SCHEMA))
    out = G.group_status(st, ["reward"], (lambda lists: {"total": G.sums(lists, lists.values.field("reward"))}, "total double")).collect()
    assert {r.agent_id: r.total for r in out} == {1: 0.0, 2: 0.5, 3: None}


def test_statuses_are_moved_once(spark, monkeypatch):
    """A status is moved to its own block and hardly to any other, however long it is valid, and no lists are moved at all."""
    monkeypatch.setattr(G, "FEWEST", 32)
    for agents in (40, 160):
        rows = [("b", 0, a, 1, t * agents + a, False, False, 0.0, 0.0, a) for a in range(agents) for t in range(2)]
        rows += [("b", 0, 0, 1, 2 * agents + t, t % 50 == 0, False, 0.0, 0.0, t) for t in range(20 * agents)]
        st = G.statuses(spark.createDataFrame(rows, SCHEMA))
        moved = G.in_blocks(st.withColumn("_to", G.until()), G.blocks_of_ticks(st)).groupBy("_own").count().collect()
        moved = {r["_own"]: r["count"] for r in moved}
        assert moved[True] == st.count() and 0 < moved[False] < st.count() / 2
        plan = G.with_mates(st, ["k"])._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and plan.count("RepartitionByExpression") == 1
