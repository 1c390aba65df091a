"""Golden values of the expressions."""

import hashlib
import hmac
import math
import random

import pytest
from pyspark.sql import functions as F

from episodica.functions import concepts as C
from episodica.functions import names as N
from episodica.functions import schedules as D
from episodica.functions import vectors as V
from episodica.operators import checks as K
from episodica.operators import metrics as M
from episodica.operators import spatial as G
from episodica.operators import stats as O


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def lit(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_decay(spark):
    lin = [value(spark, D.decay(F.lit(s), "linear", 1.0, 0.2, 9)) for s in (0, 4, 9)]
    assert lin == pytest.approx([1.0, 0.6444, 0.2], abs=1e-3)
    poly = [value(spark, D.decay(F.lit(s), "polynomial", 1.0, 0.2, 9, 0.8)) for s in (0, 4, 9)]
    assert poly == pytest.approx([1.0, 0.7, 0.2], abs=0.01)


def test_branches_and_one_hot(spark):
    assert [len(value(spark, b)) for b in V.branches_of(lit(1, 2, 3, 4, 5, 6), [2, 1, 3])] == [2, 1, 3]
    assert value(spark, V.flatten_action(None, lit(1, 0, 2), [2, 1, 3])) == [0, 1, 1, 0, 0, 1]
    for code in range(30):
        assert value(spark, V.pack_action(V.unpack_action(F.lit(code), [2, 5, 3]), [2, 5, 3])) == code


def test_transpose(spark):
    lists = F.array(lit(1.0, 2.0), lit(1.0, 2.0), lit(1.0), lit(1.0))
    assert value(spark, V.transpose_padded(lists, 3.0)) == [[1, 1, 1, 1], [2, 2, 3, 3]]


def test_hmac(spark):
    for key in ("k", "x" * 100):
        got = value(spark, N.keyed_hash(F.lit("Customer#1"), key))
        assert got == hmac.new(key.encode(), b"Customer#1", hashlib.sha256).hexdigest()


def test_names(spark):
    assert value(spark, N.behavior_team(F.lit("Name?team=3"))) == 3
    assert value(spark, N.behavior_team(F.lit("Name"))) == 0
    assert value(spark, N.sanitize(F.lit("Losses/Value Loss"))) == "Losses.ValueLoss"


def test_seed_plan_golden(spark):
    df = spark.createDataFrame([("r", 0, 0, -1), ("r", 0, 1, 7), ("r", 0, 2, -1), ("r", 1, 0, -1)], "run string, param_no int, lesson int, seed long")
    got = [r.planned_seed for r in D.seed_plan(df, 1337).orderBy("param_no", "lesson").collect()]
    assert got == [1337, 7, 1338, 1339]


def test_samplers(spark):
    with pytest.raises(ValueError):
        D.uniform(2, 1)
    df = spark.range(4000).select(
        D.sample_parameter("uniform", (2.0, 5.0), F.lit(1), "id").alias("u"),
        D.sample_parameter("gaussian", (1.0, 0.5), F.lit(1), "id").alias("g"),
        D.sample_parameter("multirangeuniform", ([(0, 1), (5, 8)],), F.lit(1), "id").alias("m"),
    )
    r = df.agg(F.avg("u"), F.min("u"), F.avg("g"), F.stddev("g"), F.avg((F.col("m") < 2).cast("int"))).first()
    assert r[0] == pytest.approx(3.5, abs=0.06) and r[1] >= 2
    assert r[2] == pytest.approx(1.0, abs=0.04) and r[3] == pytest.approx(0.5, abs=0.03)
    assert r[4] == pytest.approx(0.25, abs=0.03)
    again = spark.range(4000).repartition(7).select(D.sample_parameter("uniform", (2.0, 5.0), F.lit(1), "id").alias("u"))
    assert again.agg(F.sum("u")).first()[0] == pytest.approx(df.agg(F.sum("u")).first()[0])


def test_squashed_density_integrates(spark):
    ys = spark.range(-999, 1000).select((F.col("id") / 1000.0).alias("y"))
    p = ys.select(F.exp(V.squashed_log_prob("y", F.lit(0.2), F.lit(0.5))).alias("p"))
    assert p.agg(F.sum("p") / 1000).first()[0] == pytest.approx(1.0, abs=0.01)


def test_pick_by_mass(spark):
    for u, want in ((0.0, 0), (0.2, 0), (0.21, 1), (0.9, 2), (0.9999, 2)):
        assert value(spark, V.pick_by_mass(lit(1.0, 3.0, 5.0), F.lit(u))) == want


def test_concepts_need_twelve_values(spark):
    rays, short = lit(*[0.0, 0.0, 0.1] * 3), lit(*[0.1] * 7)
    assert value(spark, C.concept_labels(rays, short, 3, 1)["speed"]) is None
    labels = C.concept_labels(rays, lit(*[0.1] * 12), 3, 1)
    assert value(spark, labels["obstacle_in_front"]) == 1.0 and value(spark, labels["closest_obstacle_distance"]) == pytest.approx(0.1)


def test_stat_methods(spark):
    for method, want in (("AVERAGE", 2.0), ("MOST_RECENT", 4.0), ("SUM", 10.0), ("HISTOGRAM", 2.0)):
        df = spark.createDataFrame([("c", "k", float(x), method, 0, x, 0) for x in range(5)], "category string, key string, value double, method string, worker_id int, seq long, summary_step int")
        assert O.summarise_stats(df).first().aggregated_value == want


def test_gauge_golden(spark):
    df = spark.createDataFrame([("g", v, s) for s, v in enumerate([0.0, float("nan"), 2.0, 4.0])], "name string, value double, seq long")
    r = O.gauges(df).first()
    assert (r.value, r.max_value, r.min_value, r["count"]) == (4.0, 4.0, 0.0, 3)


def test_finite_guard(spark):
    df = spark.createDataFrame([(1.0, [[1.0], [2.0]])], "reward double, obs array<array<double>>")
    assert K.assert_finite(df, ["reward", "obs"]).count() == 1
    for bad in ((float("inf"), [[1.0]]), (1.0, [[float("nan")]])):
        df = spark.createDataFrame([bad], "reward double, obs array<array<double>>")
        with pytest.raises(Exception, match="non-finite"):
            K.assert_finite(df, ["reward", "obs"]).collect()


def test_concept_scores_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("speed", 0.0, nan, True), ("speed", inf, 1.0, True), ("needs_detour", nan, 1.0, True), ("appears_stuck", 2.0, 1.0, True), ("appears_stuck", 2.0, 0.0, False)]
    df = spark.createDataFrame(rows, "concept string, logit double, label double, mask boolean")
    got = {r.concept: r for r in M.per_concept_scores(df).collect()}
    assert set(got) == {"speed", "appears_stuck"}
    assert got["speed"].loss == pytest.approx((0.25 + 0.01**2) / 2, abs=1e-6)
    assert got["appears_stuck"].loss == pytest.approx(math.log1p(math.exp(-2)), abs=1e-6) and got["appears_stuck"].accuracy == 1.0


@pytest.mark.parametrize("tile_rows", [2, 50_000])
@pytest.mark.parametrize("turned", [False, True])
def test_grid_against_all_pairs(spark, tile_rows, turned):
    rng = random.Random(5)
    objs = [(0, n, rng.choice("ab"), rng.uniform(-8, 8), rng.uniform(-8, 8)) for n in range(120)]
    ags = [(0, n, objs[n][3], objs[n][4], rng.uniform(0, 360)) for n in range(20)]
    cell, size = (1.5, 2.0), (4, 3)
    want = set()
    for _, a, x, z, yaw in ags:
        c, s = (math.cos(math.radians(yaw)), math.sin(math.radians(yaw))) if turned else (1.0, 0.0)
        for _, o, tag, ox, oz in objs:
            dx, dz = (ox - x) * c - (oz - z) * s, (ox - x) * s + (oz - z) * c
            ix, iz = math.floor(dx / cell[0] + size[0] / 2), math.floor(dz / cell[1] + size[1] / 2)
            if o != a and 0 <= ix < size[0] and 0 <= iz < size[1]:
                want.add((a, ix * size[1] + iz, o))
    agents = spark.createDataFrame(ags, "tick long, agent_id long, x double, z double, yaw double")
    agents = agents if turned else agents.drop("yaw")
    objects = spark.createDataFrame(objs, "tick long, object_id long, tag string, x double, z double")
    got = G.grid_cells(agents, objects, cell, size, tile_rows=tile_rows).collect()
    assert len(got) == len(want) and {(r.agent_id, r.cell, r.object_id) for r in got} == want
    # A crowd at every place changes nothing about who is closest.
    crowd = objects.unionByName(objects.select("tick", (F.col("object_id") + 1000).alias("object_id"), "tag", "x", "z"))
    full = G.grid_closest(G.grid_cells(agents, crowd, cell, size), ["a", "b"]).collect()
    few = G.grid_closest(G.grid_cells(agents, G.nearest_candidates(crowd, ["a", "b"]), cell, size), ["a", "b"]).collect()
    assert sorted(map(tuple, full)) == sorted(map(tuple, few)) and full


def test_seen(spark):
    from episodica.operators.stats import seen

    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", 2)], "k string, v int")
    for approximate in (None, 0.05):
        assert {(r.k, r.n_seen, r.n_rows) for r in seen(df, ["k"], "v", approximate).collect()} == {("a", 1, 3), ("b", 1, 1)}
