"""The grid queries over a map of one size, however many rows stand on it."""

from math import floor

import pytest
from pyspark.sql import functions as F

from episodica import catalog
from episodica.operators import spatial as G

CUSTOMERS = [(k, k % 2) for k in range(5, 4000, 41)]
SUPPLIERS = [(k, k % 2) for k in range(1, 400, 11)]


@pytest.fixture(scope="module")
def scene_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scene"))
    spark.createDataFrame(CUSTOMERS, "c_custkey long, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame(SUPPLIERS, "s_suppkey long, s_nationkey int").write.parquet(f"{path}/supplier.parquet")
    return path


def met():
    """(tick, agent, cell, object, tag, squared distance), pair by pair."""
    objects = [(t, k + 1000000, ("food", "wall", "none")[k % 3], k * 37 % 41, k * 53 % 43) for k, t in CUSTOMERS]
    objects += [(t, k, "food", k * 17 % 41, k * 29 % 43) for k, t in SUPPLIERS]
    for k, t in SUPPLIERS:
        x, z = k * 17 % 41, k * 29 % 43
        for ot, o, tag, ox, oz in objects:
            ix, iz = floor((ox - x) / 2 + 2.5), floor((oz - z) / 3 + 3.5)
            if ot == t and o != k and 0 <= ix < 5 and 0 <= iz < 7:
                yield t, k, ix * 7 + iz, o, tag, float((ox - x) ** 2 + (oz - z) ** 2)


def rows(spark, name, path):
    catalog.load_all()
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, path).collect())


def test_objects_of_all_keys_share_one_map(spark, scene_dir):
    assert rows(spark, "grid_cell_objects", scene_dir) == sorted(met())


def test_counts_and_closest_share_it(spark, scene_dir):
    counts, closest = {}, {}
    for t, k, cell, o, tag, d in met():
        if tag != "none":
            counts.setdefault((t, k, cell), [0, 0])[tag == "wall"] += 1
            closest[t, k, cell] = min(closest.get((t, k, cell), (d, o, tag)), (d, o, tag))
    assert rows(spark, "grid_cell_counts", scene_dir) == sorted((*key, *n) for key, n in counts.items())
    assert rows(spark, "grid_cell_closest", scene_dir) == sorted((*key, o, tag, d) for key, (d, o, tag) in closest.items())


def test_repeated_and_missing_ids_hide_no_candidate(spark):
    agents = spark.createDataFrame([(0, 1, 0.0, 0.0)], "tick int, agent_id long, x double, z double")
    objects = spark.createDataFrame(
        [(0, None, "a", 0.0, 0.0), (0, 1, "a", 0.0, 0.0), (0, 1, "a", 0.0, 0.0), (0, 7, "a", 0.0, 0.0)], "tick int, object_id long, tag string, x double, z double"
    )
    found = G.grid_closest(G.grid_cells(agents, G.nearest_candidates(objects, ["a"]), (2.0, 2.0), (3, 3)), ["a"])
    assert [r.object_id for r in found.select(F.col("object_id")).collect()] == [7]
