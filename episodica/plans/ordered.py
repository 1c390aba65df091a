"""Ordered computations that survive one key holding a third of all rows.

A window over a whole key puts that key into one task. Every function here first cuts a key's order
into blocks of bounded width, works inside (key, block), reduces each block to ONE row, resolves the
carry over those rows, and joins the carry back. The only per-key window runs over block rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 18
BLOCK_CONF = "episodica.block.width"


# What tells rows of one position apart: they are handed over worker by worker, agent by agent, in their own order.
TIES = ("worker_id", "agent_id", "behavior_id", "episode", "segment", "tick")


def total_order(df: DataFrame, keys: list[str], position: str) -> list[str]:
    """The position and the columns that decide between rows at the same one."""
    return [position, *[c for c in TIES if c in df.columns and c not in keys and c != position]]


def block_width(df: DataFrame, width: int | None = None) -> int:
    return int(width or df.sparkSession.conf.get(BLOCK_CONF, str(DEFAULT_BLOCK)))


def block_of(position: Column | str, width: int) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(width)).cast("long")


def _blocked(df: DataFrame, keys: list[str], position: str, width: int | None) -> DataFrame:
    # The carry join implies these filters; stated up front, they reach both branches alike.
    out = df.withColumn("_b", block_of(position, block_width(df, width)))
    for c in [*keys, "_b"]:
        out = out.filter(F.col(c).isNotNull())
    return out


def prefix(
    df: DataFrame,
    keys: list[str],
    position: str,
    sums: dict[str, Column],
    order: list | None = None,
    inclusive: bool = True,
    width: int | None = None,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Running sums per key. `position` is a numeric order column; `order` refines it inside ties, by default with
    the columns that name a step or trajectory.

    `totals` adds sums over the whole key: they ride on the same carry, so no row meets a join on a
    (possibly hot) key alone.
    """
    whole = totals or {}
    order = order or total_order(df, keys, position)
    blocked = _blocked(df, keys, position, width)
    bk = [*keys, "_b"]
    local_w = Window.partitionBy(*bk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocked.groupBy(*bk).agg(
        *[F.sum(c).alias(f"_t_{a}") for a, c in sums.items()],
        *[F.sum(c).alias(f"_w_{a}") for a, c in whole.items()],
    )
    carry_w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(
        *bk,
        *[F.coalesce(F.sum(f"_t_{a}").over(carry_w), F.lit(0)).alias(f"_c_{a}") for a in sums],
        *[F.sum(f"_w_{a}").over(Window.partitionBy(*keys)).alias(f"_w_{a}") for a in whole],
    )
    rows = blocked.select(
        "*",
        *[F.sum(c).over(local_w).alias(f"_l_{a}") for a, c in sums.items()],
        *[c.alias(f"_o_{a}") for a, c in sums.items()],
    )
    joined = rows.join(carry, bk)

    def value(a: str) -> Column:
        total = F.col(f"_c_{a}") + F.coalesce(f"_l_{a}", F.lit(0))
        return total if inclusive else total - F.coalesce(f"_o_{a}", F.lit(0))

    return joined.select(
        *df.columns, *[value(a).alias(a) for a in sums], *[F.col(f"_w_{a}").alias(a) for a in whole]
    )


def fill_forward(
    df: DataFrame, keys: list[str], position: str, cols: dict[str, Column], width: int | None = None
) -> DataFrame:
    """Last non-null value at or before each row, per key. Rows at one position stand in their total order, terminal ones first."""
    blocked = _blocked(df, keys, position, width)
    bk = [*keys, "_b"]
    order = [F.col(c) for c in total_order(df, keys, position)]
    if "is_terminal" in df.columns:
        order.insert(1, ~F.col("is_terminal"))
    local_w = Window.partitionBy(*bk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.struct(*[c.alias(f"_{k}") for k, c in enumerate(order)])
    lasts = blocked.groupBy(*bk).agg(
        *[F.max_by(c, F.when(c.isNotNull(), rank)).alias(f"_t_{a}") for a, c in cols.items()]
    )
    carry_w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(
        *bk, *[F.last(f"_t_{a}", ignorenulls=True).over(carry_w).alias(f"_c_{a}") for a in cols]
    )
    rows = blocked.select(
        "*", *[F.last(c, ignorenulls=True).over(local_w).alias(f"_l_{a}") for a, c in cols.items()]
    )
    return rows.join(carry, bk).select(
        *df.columns, *[F.coalesce(f"_l_{a}", f"_c_{a}").alias(a) for a in cols]
    )


def with_halo(
    df: DataFrame, keys: list[str], rank: str, reach: int, width: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Prepare a `reach`-rows-back frame over a dense 0-based rank.

    Each block receives the last `reach` rows of the block before it, flagged `_halo`; a plain rows
    frame over the returned partition columns is then exact for the rows that are not halo.
    """
    width = max(block_width(df, width), reach)
    own = block_of(rank, width)
    spill = F.array(
        F.struct(own.alias("_b"), F.lit(False).alias("_halo")),
    )
    spill = F.when(
        F.pmod(F.col(rank), F.lit(width)) >= F.lit(width - reach),
        F.concat(spill, F.array(F.struct((own + 1).alias("_b"), F.lit(True).alias("_halo")))),
    ).otherwise(spill)
    spread = df.withColumn("_s", F.explode(spill)).select(*df.columns, "_s._b", "_s._halo")
    return spread, [*keys, "_b"]
