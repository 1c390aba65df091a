"""Grid sensors over tables of positions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.plans.lineage import join_stats

# Rows of one side that one task should meet per tile before the tile is split.
TILE_ROWS = 50_000


def _tile(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(width)).cast("long")


def grid_cells(
    agents: DataFrame,
    objects: DataFrame,
    cell: tuple[float, float],
    size: tuple[int, int],
    merge_copies: bool = False,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Objects inside each cell of a grid centred on each agent, the agent itself left out.

    agents: tick, agent_id, x, z, and optionally yaw (degrees; the grid turns with the agent).
    objects: tick, object_id, tag, x, z; an agent that is an object has object_id = agent_id.

    Objects fall into one coarse tile, agents look at the (at most four) tiles their grid touches, so
    the join is an equi-join on (tick, tile). A tile crowded on either side is split: its objects over
    `so` salts and its agents over `sa`, each meeting the other's every salt exactly once. A cell
    contains its low edge. `merge_copies` first counts objects sharing tick, tag and position into one
    row with weight `n`, for results that only need counts.
    """
    (cx, cz), (gx, gz) = cell, size
    turned = "yaw" in agents.columns
    rx, rz = gx * cx / 2.0, gz * cz / 2.0
    if turned:
        rx = rz = (rx * rx + rz * rz) ** 0.5
    wx, wz = 2.0 * rx, 2.0 * rz
    x, z = F.col("x"), F.col("z")
    tile = ["tick", "tx", "tz"]

    if merge_copies:
        objects = objects.groupBy("tick", "tag", "x", "z").agg(
            F.count(F.lit(1)).alias("n"), F.min("object_id").alias("object_id")
        )
    else:
        objects = objects.withColumn("n", F.lit(1).cast("long"))
    placed = objects.withColumns({"tx": _tile(x, wx), "tz": _tile(z, wz)})
    looking = (
        agents.withColumn("tx", F.explode(F.sequence(_tile(x - rx, wx), _tile(x + rx, wx))))
        .withColumn("tz", F.explode(F.sequence(_tile(z - rz, wz), _tile(z + rz, wz))))
    )
    many = F.ceil(F.count(F.lit(1)) / tile_rows).cast("int")
    crowd_o = placed.groupBy(*tile).agg(many.alias("so")).filter("so > 1")
    crowd_a = looking.groupBy(*tile).agg(many.alias("sa")).filter("sa > 1")
    crowds = crowd_o.join(crowd_a, tile, "fullouter").select(
        *tile, F.coalesce("so", F.lit(1)).alias("so"), F.coalesce("sa", F.lit(1)).alias("sa")
    )

    def salted(df: DataFrame) -> DataFrame:
        return join_stats(df, crowds, tile, "left").withColumns(
            {"so": F.coalesce("so", F.lit(1)), "sa": F.coalesce("sa", F.lit(1))}
        )

    def salts(n: str) -> Column:
        return F.sequence(F.lit(0), F.col(n) - 1)

    o = (
        salted(placed)
        .withColumn("ko", F.pmod(F.xxhash64("object_id", "tag", "x", "z"), F.col("so")).cast("int"))
        .withColumn("ka", F.explode(salts("sa")))
        .select(*tile, "ka", "ko", "object_id", "tag", "n", F.col("x").alias("ox"), F.col("z").alias("oz"))
    )
    a = (
        salted(looking)
        .withColumn("ka", F.pmod(F.xxhash64("agent_id"), F.col("sa")).cast("int"))
        .withColumn("ko", F.explode(salts("so")))
        .drop("so", "sa")
    )
    dx, dz = F.col("ox") - F.col("x"), F.col("oz") - F.col("z")
    if turned:
        c, s = F.cos(F.radians("yaw")), F.sin(F.radians("yaw"))
        dx, dz = dx * c - dz * s, dx * s + dz * c
    met = a.join(o, [*tile, "ka", "ko"]).withColumns(
        {
            "ix": F.floor(dx / cx + gx / 2.0).cast("long"),
            "iz": F.floor(dz / cz + gz / 2.0).cast("long"),
            "dist2": dx * dx + dz * dz,
        }
    )
    inside = F.col("ix").between(0, gx - 1) & F.col("iz").between(0, gz - 1)
    met = met.filter(inside).withColumn("cell", F.col("ix") * gz + F.col("iz"))
    if merge_copies:
        # The agent stands at its own position: take it off that position's count.
        mine = (F.col("dist2") == 0) & (F.col("tag") == F.col("self_tag")) if "self_tag" in agents.columns else F.lit(False)
        met = met.withColumn("n", F.col("n") - F.coalesce(mine, F.lit(False)).cast("long")).filter("n > 0")
    else:
        met = met.filter(F.col("object_id") != F.col("agent_id"))
    return met.select("tick", "agent_id", "cell", "object_id", "tag", "n", "dist2")


def nearest_candidates(objects: DataFrame, tags: list[str]) -> DataFrame:
    """The objects that can be closest to anyone: of those at one place the two smallest ids, as one of them may be the agent that looks.

    Each task keeps only rows of two ids of a place before the exchange, so a crowd at a place meets no agent. Rows of one id all stay; an object
    without id is never anyone's other."""
    w = Window.partitionBy("tick", "x", "z").orderBy("object_id")
    known = objects.filter(F.col("tag").isin(tags) & F.col("object_id").isNotNull())
    return known.withColumn("_r", F.dense_rank().over(w)).filter("_r <= 2").drop("_r")


def grid_counts(cells: DataFrame, tags: list[str]) -> DataFrame:
    """Objects per cell, one column per tag."""
    return (
        cells.filter(F.col("tag").isin(tags))
        .groupBy("tick", "agent_id", "cell")
        .agg(*[F.sum(F.when(F.col("tag") == t, F.col("n")).otherwise(0)).alias(t) for t in tags])
    )


def grid_closest(cells: DataFrame, tags: list[str]) -> DataFrame:
    """Nearest tagged object per cell; the smaller object id wins a tie."""
    return (
        cells.filter(F.col("tag").isin(tags))
        .groupBy("tick", "agent_id", "cell")
        .agg(F.min(F.struct("dist2", "object_id", "tag")).alias("m"))
        .select("tick", "agent_id", "cell", "m.object_id", "m.tag", "m.dist2")
    )


def cap_entities(entities: DataFrame, k: int, size: int, keys: list[str], order: str, vec: str = "vec") -> DataFrame:
    """The first k entities of each observer, zero rows up to k. At most k rows per key are collected."""
    w = Window.partitionBy(*keys).orderBy(order)
    zero = F.array(*[F.lit(0.0)] * size)
    return (
        entities.withColumn("_r", F.row_number().over(w))
        .filter(F.col("_r") <= k)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_r", F.col(vec).alias("v")))).alias("_e"))
        .withColumn("entities", F.concat(F.col("_e.v"), F.array_repeat(zero, F.lit(k) - F.size("_e"))))
        .withColumn("n_entities", F.size("_e"))
        .drop("_e")
    )
