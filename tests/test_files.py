"""File formats, their errors, and stored tables."""

import json

import pytest
from pyspark.sql import functions as F

from episodica.catalog.files import demo_bytes
from episodica.operators import checks as K
from episodica.operators import stats as O
from episodica.sources import demo_ranges as ranges
from episodica.sources import demos, logs
from episodica.sources import replay as R

ROWS = [(0.5, False, False, 7, [1.0, 2.0], 1), (1.0, True, True, 7, [3.0, 4.0], 2), (0.25, False, False, 7, [5.0, 6.0], 3)]


def test_demo_folder(spark, tmp_path):
    (tmp_path / "a.demo").write_bytes(demo_bytes("x", ROWS))
    (tmp_path / "b.demo").write_bytes(demo_bytes("x", ROWS[:2]))
    (tmp_path / "notes.txt").write_text("no")
    df = ranges.read_demos(spark, str(tmp_path))
    rows = df.filter(F.col("path").endswith("a.demo")).orderBy("tick").collect()
    assert df.count() == 5
    assert [(r.reward, r.is_terminal, r.interrupted, r.agent_id, r.obs, r.discrete) for r in rows] == [
        (r[0], r[1], r[2], r[3], [r[4]], [r[5]]) for r in ROWS
    ]
    crossed = demos.demo_experiences(df, cross_episode=True)
    assert crossed.filter(F.col("path").endswith("a.demo")).count() == 2
    clean = demos.demo_experiences(df).filter(F.col("path").endswith("a.demo")).collect()
    assert [(r.tick, r.done, r.interrupted, r.reward) for r in clean] == [(0, True, True, 1.0)]
    cat = ranges.demo_catalog(spark, str(tmp_path / "a.demo")).first()
    assert (cat.number_steps, cat.discrete_branches, cat.shapes, cat.behavior_id) == (3, [5], [[2]], "x")


def test_one_file_in_many_ranges(spark, tmp_path):
    """Ranges cover a large file's records once, in order, up to the declared steps, and several tasks read them."""
    rows = [(k / 8, k % 50 == 49, False, k % 3, [float(k)] * (1 + k % 40), k % 5) for k in range(3000)]
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "large.demo").write_bytes(demo_bytes("x", rows))
    (tmp_path / "two" / "small.demo").write_bytes(demo_bytes("y", rows[:10]))
    fewer = demo_bytes("z", rows[:700])
    (tmp_path / "two" / "cut.demo").write_bytes(fewer[:33] + demo_bytes("z", rows)[33:])
    folders = [str(tmp_path / "one"), str(tmp_path / "two")]
    found = ranges.demo_ranges(demos.demo_files(spark, folders), 4096)
    large = sorted((r.first, r.n) for r in found.filter(F.col("path").endswith("large.demo")).collect())
    assert len(large) > 20 and [a + n for a, n in large] == [*[a for a, _ in large[1:]], 3000]
    got = ranges.read_demos(spark, folders, 4096)
    one = got.filter(F.col("path").endswith("large.demo"))
    assert one.select(F.spark_partition_id()).distinct().count() > 1
    assert [(r.tick, r.agent_id, r.obs[0][0]) for r in one.orderBy("tick").collect()] == [(k, k % 3, float(k)) for k in range(3000)]
    assert got.filter(F.col("path").endswith("small.demo")).count() == 10 and got.filter(F.col("path").endswith("cut.demo")).count() == 700
    ranges.register(spark)
    source = spark.read.format("demonstrations").option("split", 4096).load(folders[0])
    assert source.rdd.getNumPartitions() > 20 and source.agg(F.sum("tick")).first()[0] == 3000 * 2999 // 2
    assert {(r.behavior_id, r.number_steps) for r in ranges.demo_catalog(spark, folders).collect()} == {("x", 3000), ("y", 10), ("z", 700)}


def test_demo_stops_at_declared_steps(spark, tmp_path):
    whole = demo_bytes("x", ROWS)
    one = demo_bytes("x", ROWS[:1])
    (tmp_path / "a.demo").write_bytes(one[:33] + whole[33:])
    assert ranges.read_demos(spark, str(tmp_path / "a.demo")).count() == 1


def test_demo_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ranges.read_demos(spark, str(tmp_path / "missing"))
    with pytest.raises(ValueError):
        ranges.read_demos(spark, str(tmp_path))
    (tmp_path / "x.txt").write_text("no")
    with pytest.raises(ValueError):
        ranges.read_demos(spark, str(tmp_path / "x.txt"))
    (tmp_path / "v.demo").write_bytes(demo_bytes("x", ROWS, version=1337))
    with pytest.raises(Exception, match="unsupported demonstration version"):
        ranges.read_demos(spark, str(tmp_path / "v.demo")).count()


def test_timer_tree(spark, tmp_path):
    tree = {"name": "root", "total": 10.0, "count": 1, "self": 1.0, "gauges": {"g": {"value": 4.0, "max": 4.0, "min": 0.0, "count": 3}},
            "children": {"top": {"total": 9.0, "count": 1, "self": 6.0, "children": {"multiple": {"total": 3.0, "count": 3, "self": 3.0, "is_parallel": True}}}}}
    (tmp_path / "timers.json").write_text(json.dumps(tree))
    spans = logs.read_timer_trees(spark, str(tmp_path / "timers.json"))
    got = {"/".join(r.path): (r.total, r["count"], r.is_parallel) for r in spans.collect()}
    assert got == {"root": (10.0, 1, False), "root/top": (9.0, 1, False), "root/top/multiple": (3.0, 3, True)}
    own = {"/".join(r.path): r.self_time for r in O.span_self_time(spans.drop("self_time")).collect()}
    assert own == {"root": 1.0, "root/top": 6.0, "root/top/multiple": 3.0}
    g = logs.parse_gauges(spark.read.text(str(tmp_path / "timers.json"), wholetext=True).withColumn("source", F.lit("s"))).first()
    assert (g.name, g.value, g["count"]) == ("g", 4.0, 3)


def test_run_configs(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("default_settings: null\nbehaviors:\n  Ball:\n    trainer_type: ppo\n    reward_signals:\n      curiosity:\n        strength: 0.02\n    network_settings:\n      memory:\n        memory_size: 64\n      hidden_units: 128\nenvironment_parameters:\n  mass:\n    curriculum:\n      - name: L0\n        value: 1\n")
    conf = logs.read_run_configs(spark, str(tmp_path))
    flags = K.config_features(conf).filter("behavior = 'Ball'").first()
    assert flags.curiosity_enabled and flags.recurrent_enabled and not flags.gail_enabled and flags.hidden_units == "128"
    keys = {r.key_path: r.value for r in conf.filter("behavior = '*'").collect()}
    assert keys["environment_parameters.mass.curriculum.0.value"] == "1"
    assert json.loads(logs.config_json(conf).filter("behavior = 'Ball'").first().config)["trainer_type"] == "ppo"


def test_old_column_name(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, 2)], "behavior_id string, group_discrete_aaction int, `obs:0` int")
    R.save_replay(df, str(tmp_path / "r"))
    got = R.load_replay(spark, str(tmp_path / "r"), "b")
    assert set(got.columns) == {"behavior_id", "group_discrete_action", "obs:0"}


def test_names_come_back(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, 2, 3, 4)], "behavior_id string, `a:b` int, a__b int, `obs:0:x` int, obs__0 int")
    R.save_replay(df, str(tmp_path / "r"))
    got = R.load_replay(spark, str(tmp_path / "r"))
    assert got.select("a:b", "a__b", "obs:0:x", "obs__0", "behavior_id").first() == (1, 2, 3, 4, "b")


def test_deep_trees(spark):
    tree = leaf = {"name": "root", "total": 1, "count": 1}
    for _ in range(400):
        leaf["children"] = {"x": {"total": 1, "count": 1}}
        leaf = leaf["children"]["x"]
    df = spark.createDataFrame([("s", json.dumps(tree))], "source string, value string")
    assert logs.parse_timer_trees(df).count() == 401


def test_episode_stats(spark):
    line = "[2025-02-03 04:05:06] [EPISODE STATS] ptVisits=3 | recharges=1 | steps=250 | mode=free | avgPtVisits=2.50 | avgRecharges=0.75 | eps=12"
    df = spark.createDataFrame([(line,), ("[2025-02-03 04:05:06] [EPISODE END] reason=done",)], "value string")
    r = logs.parse_episode_stats(df).collect()
    assert len(r) == 1 and (r[0].mode, r[0].pt_visits, r[0].recharges, r[0].steps, r[0].mean_pt_visits, r[0].mean_recharges, r[0].episodes) == ("free", 3, 1, 250, 2.5, 0.75, 12)


def test_stat_events_put_aside(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"key": "a", "method": "SUM", "seq": 1}\n{"key": "b", "method": "MEDIAN", "seq": 2}\n{"key": "c", "seq": 3}\n')
    good, bad = logs.split_methods(logs.read_stat_events(spark, str(tmp_path), "json", unknown="keep"))
    assert [r.seq for r in good.collect()] == [1] and sorted(r.seq for r in bad.collect()) == [2, 3]
    with pytest.raises(Exception, match="unknown aggregation method"):
        logs.read_stat_events(spark, str(tmp_path), "json").collect()


def test_stat_methods_checked(spark):
    df = spark.createDataFrame([("MEDIAN",)], "method string")
    with pytest.raises(Exception, match="unknown aggregation method"):
        logs.checked_methods(df).collect()


def test_checkpoint_retention(spark):
    df = spark.createDataFrame([("b", n, f"f{n}", 0.0, float(n)) for n in range(6)], "behavior string, steps long, file_path string, reward double, creation_time double")
    assert sorted(r.steps for r in O.keep_checkpoints(df, 2).collect()) == [4, 5]
    assert O.keep_checkpoints(df, 0).count() == 6
    assert sorted(r.steps for r in O.expired_checkpoints(df, 2).collect()) == [0, 1, 2, 3]


def test_one_demonstration_an_agent_and_span(spark, tmp_path):
    from datetime import datetime

    from episodica import catalog

    kinds = ("click", "purchase", "view")
    rows = [(t, t % 3, kinds[t % 3], float(t % 100), f'{{"k": {t % 7}}}', datetime(2025, 1, 1)) for t in range(0, 2000, 40)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    catalog.load_all()
    got = {r.path: (r.n, r.agents, r.ends) for r in catalog.QUERIES["demonstrations_by_sql"](spark, str(tmp_path)).collect()}
    want = {}
    for t, agent, kind, *_ in rows:
        n, agents, ends = want.get(f"{agent}-{t // 500}", (0, 0, 0))
        want[f"{agent}-{t // 500}"] = (n + 1, agents + agent, ends + (kind == "purchase"))
    assert got == want and len(want) == 12
