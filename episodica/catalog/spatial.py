"""Grid sensor queries; the SQL side is a plain inequality join."""

from pyspark.sql import functions as F

from episodica.catalog import EPISODES_SQL, query, r, table
from episodica.catalog.sessions import steps
from episodica.functions import vectors as V
from episodica.functions.numbers import steady
from episodica.operators import sessions as S
from episodica.operators import spatial as G
from episodica.schema import AGENT

OBJ_SQL = """
obj AS (SELECT c_nationkey AS tick, c_custkey + 1000000 AS id, CASE c_custkey % 3 WHEN 0 THEN 'food' WHEN 1 THEN 'wall' ELSE 'none' END AS tag,
   CAST(c_custkey * 37 % 41 AS DOUBLE) AS x, CAST(c_custkey * 53 % 43 AS DOUBLE) AS z FROM customer
 UNION ALL SELECT s_nationkey, s_suppkey, 'food', CAST(s_suppkey * 17 % 41 AS DOUBLE), CAST(s_suppkey * 29 % 43 AS DOUBLE) FROM supplier),
ag AS (SELECT s_nationkey AS tick, s_suppkey AS agent_id, CAST(s_suppkey * 17 % 41 AS DOUBLE) AS x,
   CAST(s_suppkey * 29 % 43 AS DOUBLE) AS z FROM supplier),
p AS (SELECT ag.tick, ag.agent_id, obj.id, obj.tag, floor((obj.x - ag.x) / 2.0 + 2.5) AS ix, floor((obj.z - ag.z) / 3.0 + 3.5) AS iz,
   power(obj.x - ag.x, 2) + power(obj.z - ag.z, 2) AS dist2
 FROM ag JOIN obj ON obj.tick = ag.tick AND obj.id <> ag.agent_id),
cells AS (SELECT tick, agent_id, CAST(ix * 7 + iz AS BIGINT) AS cell, id AS object_id, tag, dist2 FROM p
 WHERE ix BETWEEN 0 AND 4 AND iz BETWEEN 0 AND 6)"""


def scene(spark, sf_dir):
    """Customers and suppliers as objects, suppliers as agents; a nation is a tick."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("tick"), (F.col("c_custkey") + 1000000).alias("object_id"),
        F.element_at(F.array(F.lit("food"), F.lit("wall"), F.lit("none")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("tag"),
        (F.col("c_custkey") * 37 % 41).cast("double").alias("x"), (F.col("c_custkey") * 53 % 43).cast("double").alias("z"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("tick"), F.col("s_suppkey").alias("object_id"), F.lit("food").alias("tag"),
        (F.col("s_suppkey") * 17 % 41).cast("double").alias("x"), (F.col("s_suppkey") * 29 % 43).cast("double").alias("z"),
    )
    agents = s.withColumnsRenamed({"object_id": "agent_id", "tag": "self_tag"})
    return agents, c.unionByName(s)


@query("grid_cell_objects", f"WITH {OBJ_SQL} SELECT tick, agent_id, cell, object_id, tag, {r('dist2')} AS dist2 FROM cells")
def grid_cell_objects(spark, sf_dir):
    out = G.grid_cells(*scene(spark, sf_dir), (2.0, 3.0), (5, 7))
    return out.select("tick", "agent_id", "cell", "object_id", "tag", steady("dist2").alias("dist2"))


@query(
    "grid_cell_counts",
    f"""WITH {OBJ_SQL} SELECT tick, agent_id, cell, CAST(sum(CAST(tag = 'food' AS INT)) AS BIGINT) AS food,
CAST(sum(CAST(tag = 'wall' AS INT)) AS BIGINT) AS wall FROM cells WHERE tag IN ('food', 'wall') GROUP BY 1, 2, 3""",
)
def grid_cell_counts(spark, sf_dir):
    cells = G.grid_cells(*scene(spark, sf_dir), (2.0, 3.0), (5, 7), merge_copies=True)
    return G.grid_counts(cells, ["food", "wall"])


@query(
    "grid_cell_closest",
    f"""WITH {OBJ_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY tick, agent_id, cell ORDER BY dist2, object_id) AS n
FROM cells WHERE tag IN ('food', 'wall')) SELECT tick, agent_id, cell, object_id, tag, {r('dist2')} AS dist2 FROM o WHERE n = 1""",
)
def grid_cell_closest(spark, sf_dir):
    agents, objects = scene(spark, sf_dir)
    near = G.nearest_candidates(objects, ["food", "wall"])
    out = G.grid_closest(G.grid_cells(agents, near, (2.0, 3.0), (5, 7)), ["food", "wall"])
    return out.select("tick", "agent_id", "cell", "object_id", "tag", steady("dist2").alias("dist2"))


@query(
    "entities_capped",
    f"""WITH {EPISODES_SQL} SELECT agent_id, episode, CAST(least(count(*), 5) AS INT) AS n_entities,
CAST(sum(CASE WHEN i < 5 THEN k ELSE 0 END) AS BIGINT) AS total, 5 AS padded FROM seq GROUP BY agent_id, episode""",
)
def entities_capped(spark, sf_dir):
    st = S.with_episode(steps(spark, sf_dir, *AGENT, "tick", "is_terminal", "k"))
    ents = st.withColumn("vec", F.array(F.col("k").cast("double"), F.lit(0.0)))
    out = G.cap_entities(ents, 5, 2, [*AGENT, "episode"], "i")
    return out.select(
        "agent_id", "episode", "n_entities", V.total(F.flatten("entities")).cast("long").alias("total"),
        F.size("entities").alias("padded"),
    )
