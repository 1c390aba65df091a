"""Hyper-parameter schedules and parameter samplers as Column expressions."""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.numbers import as_col, spread_uniform, text_key
from episodica.plans.ordered import prefix


def decay(step, schedule: str, initial: float, minimum: float, max_step: int, power: float = 1.0) -> Column:
    """A constant, or a polynomial decay to a floor (linear is power 1)."""
    if schedule == "constant":
        return F.lit(float(initial))
    if schedule not in ("linear", "polynomial"):
        raise ValueError(f"unknown schedule {schedule}")
    power = 1.0 if schedule == "linear" else power
    left = 1.0 - F.least(as_col(step).cast("double"), F.lit(float(max_step))) / F.lit(float(max_step))
    return F.lit(float(initial - minimum)) * F.pow(left, F.lit(float(power))) + F.lit(float(minimum))


def constant(value: float) -> Callable[..., Column]:
    return lambda *u: F.lit(float(value))


def uniform(low: float, high: float) -> Callable[..., Column]:
    if low > high:
        raise ValueError("minimum above maximum")
    return lambda u, *_: F.lit(float(low)) + as_col(u) * F.lit(float(high - low))


def gaussian(mean: float, std: float) -> Callable[..., Column]:
    """Box-Muller over two uniforms."""

    def draw(u1, u2):
        radius = F.sqrt(-2.0 * F.ln(1.0 - as_col(u1)))
        return F.lit(float(mean)) + F.lit(float(std)) * radius * F.cos(F.lit(2 * math.pi) * as_col(u2))

    return draw


def multi_range(intervals: list[tuple[float, float]]) -> Callable[..., Column]:
    """Uniform over a union of intervals, each chosen in proportion to its length."""
    for low, high in intervals:
        if low > high:
            raise ValueError("minimum above maximum")
    lengths = [high - low for low, high in intervals]
    whole = sum(lengths)

    def draw(u1, u2):
        out, reached = None, 0.0
        for (low, high), n in zip(intervals, lengths):
            reached += n
            value = F.lit(float(low)) + as_col(u2) * F.lit(float(high - low))
            hit = as_col(u1) * F.lit(float(whole)) < F.lit(float(reached))
            out = F.when(hit, value) if out is None else out.when(hit, value)
        low, high = intervals[-1]
        return out.otherwise(F.lit(float(low)) + as_col(u2) * F.lit(float(high - low)))

    return draw


# Sampler kinds a run configuration may name; a user can add to it.
SAMPLERS: dict[str, Callable[..., Callable[..., Column]]] = {
    "constant": constant,
    "uniform": uniform,
    "gaussian": gaussian,
    "multirangeuniform": multi_range,
}


def sample_parameter(kind: str, args: tuple, seed, *ids) -> Column:
    """A repeatable draw per row: hashed from seed and ids, so independent of partitioning and of the engine."""
    draw, key = SAMPLERS[kind](*args), text_key(*ids)
    return draw(*(spread_uniform(as_col(seed), key, seed=n) for n in (1, 2)))


def seed_plan(lessons: DataFrame, run_seed: int) -> DataFrame:
    """Lessons without a seed get the run's seed plus a running offset, in (parameter, lesson) order.

    Columns: run, param_no, lesson, seed (-1 = unset).
    """
    unset = F.col("seed") == -1
    counted = prefix(
        lessons, ["run"], "param_no", {"_offset": unset.cast("long")}, ["param_no", "lesson"], inclusive=False
    )
    return counted.withColumn(
        "planned_seed", F.when(unset, F.lit(run_seed) + F.col("_offset")).otherwise(F.col("seed"))
    ).drop("_offset")
