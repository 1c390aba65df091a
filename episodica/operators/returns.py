"""Discounted returns, advantages and their bootstrap, per trajectory.

A suffix recurrence x_t = d_t + q x_{t+1} is the window sum(d_k q^k) / q^t over a descending order:
Spark grows that frame one row at a time, where a following frame would be recomputed for each row.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from episodica.operators.sessions import trajectory_window
from episodica.schema import TRAJECTORY


def suffix_discount(value: Column, q: float, horizon: int) -> Column:
    """sum over k >= t of q^(k-t) value_k inside the trajectory."""
    if q == 0.0:
        return value
    w = trajectory_window(descending=True).rowsBetween(Window.unboundedPreceding, 0)
    if q == 1.0:
        return F.sum(value).over(w)
    if horizon * math.log10(q) < -200:
        # q^j would run out of range: fold the rows that still count, those until q^k falls below 1e-60.
        reach = math.ceil(-60 / math.log10(q))
        seen = F.collect_list(value).over(trajectory_window(descending=True).rowsBetween(-reach, 0))
        return F.aggregate(seen, F.lit(0.0), lambda acc, x: acc * q + x)
    weight = F.pow(F.lit(float(q)), F.col("j").cast("double"))
    return F.sum(value * weight).over(w) / weight


def bootstrap(exp: DataFrame, ignore_done: bool = False) -> DataFrame:
    """Value of the state after each step: nothing follows a real end, something follows a time-out."""
    ended = F.col("done") & ~F.col("interrupted")
    value = F.col("next_value") if ignore_done else F.when(ended, F.lit(0.0)).otherwise(F.col("next_value"))
    return exp.withColumn("v_next", value)


def group_bootstrap(exp: DataFrame) -> DataFrame:
    """Cooperative form: the baseline stops only when the agent and all its mates are done."""
    ended = F.col("done") & ~F.col("interrupted") & F.col("group_done")
    return exp.withColumn("group_v_next", F.when(ended, F.lit(0.0)).otherwise(F.col("next_value")))


def last_step() -> Column:
    return F.col("i") == F.max("i").over(Window.partitionBy(*TRAJECTORY))


def discounted_returns(exp: DataFrame, gamma: float, horizon: int, reward: str = "reward") -> DataFrame:
    """Discounted sum of rewards to the trajectory's end plus its discounted bootstrap value."""
    value = F.col(reward) + F.when(F.col("_last"), F.lit(float(gamma)) * F.col("v_next")).otherwise(F.lit(0.0))
    return (
        exp.withColumn("_last", last_step())
        .withColumn("discounted_return", suffix_discount(value, gamma, horizon))
        .drop("_last")
    )


def gae(
    exp: DataFrame, gamma: float, lam: float, horizon: int, reward: str = "reward", alias: str = "advantage"
) -> DataFrame:
    """Generalised advantage estimate; returns = advantage + value."""
    delta = F.col(reward) + F.lit(float(gamma)) * F.col("v_next") - F.col("value_est")
    return exp.withColumn(alias, suffix_discount(delta, gamma * lam, horizon)).withColumn(
        "returns", F.col(alias) + F.col("value_est")
    )


def lambda_return(exp: DataFrame, gamma: float, lam: float, horizon: int, reward: str = "reward") -> DataFrame:
    """TD(lambda) return, by its own recurrence; its advantage is against a baseline column when given."""
    gamma, lam = float(gamma), float(lam)
    base = F.col(reward) + F.when(F.col("_last"), F.lit(gamma) * F.col("v_next")).otherwise(
        F.lit((1.0 - lam) * gamma) * F.col("v_next")
    )
    out = (
        exp.withColumn("_last", last_step())
        .withColumn("lambda_return", suffix_discount(base, gamma * lam, horizon))
        .drop("_last")
    )
    if "baseline" in exp.columns:
        out = out.withColumn("baseline_advantage", F.col("lambda_return") - F.col("baseline"))
    return out


def combine_signals(long: DataFrame, keys: list[str]) -> DataFrame:
    """Global advantage and return: the mean over reward signals."""
    return long.groupBy(*keys).agg(
        F.avg("advantage").alias("advantage"), F.avg("returns").alias("returns")
    )


def off_policy_fix(exp: DataFrame, obs: str = "obs", next_obs: str = "next_obs") -> DataFrame:
    """A timed-out episode did not end: last next observation := last observation, done := false."""
    hit = F.col("done") & F.col("interrupted")
    return exp.withColumn(next_obs, F.when(hit, F.col(obs)).otherwise(F.col(next_obs))).withColumn(
        "done", F.col("done") & ~hit
    )


def extrinsic_reward(exp: DataFrame, mates: str | None = None, group: str | None = None) -> DataFrame:
    """Own reward, plus (optionally) the mates' rewards and the group reward."""
    total = F.col("reward")
    if mates:
        total = total + F.coalesce(F.col(mates), F.lit(0.0))
    if group:
        total = total + F.coalesce(F.col(group), F.lit(0.0))
    return exp.withColumn("extrinsic", total)
