"""Mixing sources to target weights along a curriculum.

Targets: every source has a weight and gets that share of the token budget, but never more than `max_epochs` times
its own size; what is over is shared again by weight among the others until none is above its cap (water-filling,
solved in closed form over the source table ordered by cap per weight).

Curriculum: the weight of a source varies over training time 0..1. The integral of its schedule, scaled to its target,
is the cumulative demand for its tokens; a document copy that covers the tokens around c of its source is trained on at
the time where that demand reaches c. The copies of all sources are range-sorted by that time.

Cases: a null source is a source of its own, ordered last; a null or empty text has size 0, is taken 0 words and has no
position; a source of only empty texts has target 0; repeated rows (same id, text and source) are taken equally often, at
the same times; an empty table gives an empty mix; other columns pass through `mixed` untouched, whatever their names.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import cut, fresh_name, n_words, order_hash, text_of

ROWS_PER_BLOCK = 50_000


@dataclass(frozen=True)
class Curriculum:
    """Schedules by turns: source number k has weight weights[k % len] on average, shaped in time by shapes[k % len],
    a list of (time, relative weight) knots from time 0 to 1, linear in between."""

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    shapes: tuple[tuple[tuple[float, float], ...], ...] = (
        ((0.0, 1.5), (1.0, 0.5)),
        ((0.0, 1.0), (1.0, 1.0)),
        ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)),
    )
    max_epochs: int = 3


def source_targets(sized: DataFrame, plan: Curriculum) -> DataFrame:
    """(source, source_size, rank, weight, target) from (source, size). One row per source."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(plan.weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, plan.weights)), (F.col("rank") % n + 1).cast("int"))
    src = src.withColumn("rank", rank).withColumn("weight", weight)
    src = src.withColumn("cap", (F.col("source_size") * plan.max_epochs).cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = (
        src.withColumn("total", F.sum("source_size").over(everywhere).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rest))
        .withColumn("capped", F.col("cap") * F.col("open") <= F.col("weight") * F.col("left"))
        .withColumn("capped_sum", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everywhere), F.lit(0.0)))
        .withColumn("open_sum", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everywhere))
    )
    shared = F.col("weight") * (F.col("total") - F.col("capped_sum")) / F.col("open_sum")
    return src.select(
        "source", "source_size", "rank", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(shared).alias("target")
    )


def cumulative(rows: DataFrame, size: str, keys: list[str], order: list[str], n_rows: int) -> DataFrame:
    """Adds `before`: the sum of size over earlier rows of the key. The order hash is cut into blocks, so that a key with
    a third of all rows is summed in many tasks: block sums first, then rows inside their block."""
    bits = max(0, (n_rows // ROWS_PER_BLOCK).bit_length())
    rows = rows.withColumn("_block", F.shiftright(F.col(order[0]), 60 - bits))
    sums = rows.groupBy(*keys, "_block").agg(F.sum(size).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"),
                         F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_start"))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, same)
        .withColumn("before", F.col("_start") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .drop("_block", "_b", "_start", "_sum", *[f"_k{i}" for i in range(len(keys))])
    )


def demand_time(share: Column, shape: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of a piecewise linear schedule has reached `share` (0..1) of its whole."""
    parts, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(shape, shape[1:]):
        parts.append((t0, w0, (w1 - w0) / (t1 - t0), total))
        total += (t1 - t0) * (w0 + w1) / 2
    out = None
    for t0, w0, slope, start in reversed(parts):
        y = F.greatest(share * F.lit(total) - F.lit(start), F.lit(0.0))
        root = F.sqrt(F.lit(w0 * w0) + F.lit(2 * slope) * y)
        at = F.lit(t0) + F.when(y > 0, F.lit(2.0) * y / (F.lit(w0) + root)).otherwise(0.0)
        out = at if out is None else F.when(share * F.lit(total) < F.lit(last), at).otherwise(out)
        last = start
    return out


def plan_mix(docs: DataFrame, plan: Curriculum = Curriculum(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, key, source, size, n_rows, source_size, target, copies, positions): a row for each different document.

    n_rows rows of docs share id, text and source; they are planned together. A source is taken floor(target / size)
    times as a whole; the rest comes from its first documents in hash order, up to half a document from the target.
    positions: one training time for each copy, in order."""
    text = text_of(text_col)
    per_doc = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"),
        order_hash(F.col(id_col), text).alias("key"),
    )
    per_doc = cut(per_doc.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("n_rows")), "sized")
    sized = per_doc.withColumn("words", F.col("size") * F.col("n_rows"))
    targets = source_targets(sized.select("source", F.col("words").alias("size")), plan)
    targets = targets.select(F.col("source").alias("_source"), "source_size", "rank", "target")
    rows = cumulative(sized, "words", ["source"], ["key", "doc_id"], per_doc.count())
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("_full", F.least(full, F.lit(plan.max_epochs)).cast("long"))
    middle = F.col("before") + F.col("words") / 2
    extra = (middle <= F.col("target") - F.col("_full") * F.col("source_size")) & (F.col("_full") < plan.max_epochs)
    copies = F.when(F.col("size") > 0, F.col("_full") + extra.cast("long")).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("long"))

    def at(epoch: int) -> Column:
        share = F.least((middle + F.lit(epoch) * F.col("source_size")) / F.col("target"), F.lit(1.0))
        n = len(plan.shapes)
        out = demand_time(share, plan.shapes[-1])
        for k in range(n - 1):
            out = F.when(F.col("rank") % n == k, demand_time(share, plan.shapes[k])).otherwise(out)
        return out

    slots = F.array(*[F.when(F.col("copies") > e, at(e)) for e in range(plan.max_epochs)])
    return rows.select(
        "doc_id", "key", "source", "size", "n_rows", "source_size", "target", "copies",
        F.filter(slots, lambda x: x.isNotNull()).alias("positions"),
    )


def mixed(docs: DataFrame, plan: Curriculum = Curriculum(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents in training order: every taken copy is a row with all columns of docs and its position."""
    name, key = fresh_name(docs, "position"), fresh_name(docs, "mix_key")
    pos, pk, pid, ps = (fresh_name(docs, x) for x in ("mix_positions", "mix_plan_key", "mix_plan_id", "mix_plan_source"))
    chosen = plan_mix(docs, plan, id_col, text_col, source_col).filter("copies > 0")
    chosen = chosen.select(F.col("key").alias(pk), F.col("doc_id").alias(pid), F.col("source").alias(ps), F.col("positions").alias(pos))
    keyed = docs.withColumn(key, order_hash(F.col(id_col), text_of(text_col)))
    same = (F.col(key) == F.col(pk)) & F.col(id_col).eqNullSafe(F.col(pid)) & F.col(source_col).eqNullSafe(F.col(ps))
    return keyed.join(chosen, same).withColumn(name, F.explode(pos)).drop(pos, pk, pid, ps, key).orderBy(name)
