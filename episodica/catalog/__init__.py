"""Registered queries: each pairs a Spark plan with the SQL another engine can check it by."""

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = (
    "sessions",
    "returns",
    "reporting",
    "replay",
    "groups",
    "columns",
    "training",
    "selfplay",
    "spatial",
    "files",
    "checks",
    "streams",
)


def query(name: str, sql: str | None = None):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"episodica.catalog.{m}")


# --- shared SQL text -------------------------------------------------------------------------

STEPS_SQL = """
steps AS (
  SELECT event_id AS tick, user_id AS agent_id, user_id % 4 AS worker_id, user_id % 10 AS group_id,
         'b' || (user_id % 3) || '?team=' || (user_id % 2) AS behavior_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         value / 100.0::DOUBLE - 0.5::DOUBLE AS reward,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) / 100.0::DOUBLE AS group_reward,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) / 100.0::DOUBLE AS value_est,
         event_type = 'purchase' AS is_terminal,
         event_type = 'purchase' AND CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 4 = 0
           AS interrupted,
         CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2
              WHEN 'error' THEN 3 ELSE 4 END AS action,
         event_type, value, ts
  FROM events)"""

EPISODES_SQL = (
    STEPS_SQL
    + """,
numbered AS (
  SELECT *, CAST(coalesce(sum(CAST(is_terminal AS INT)) OVER (PARTITION BY agent_id ORDER BY tick
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS episode FROM steps),
seq AS (
  SELECT *, row_number() OVER w - 1 AS i, lead(tick) OVER w AS next_tick,
         lead(reward) OVER w AS r1, lead(group_reward) OVER w AS g1, lead(is_terminal) OVER w AS d1,
         lead(interrupted) OVER w AS n1, lead(value_est) OVER w AS next_value,
         lead(k) OVER w AS next_k, lead(action) OVER w AS a1, lag(action) OVER w AS a0
  FROM numbered WINDOW w AS (PARTITION BY agent_id, episode ORDER BY tick))"""
)


def experiences_sql(horizon: int) -> str:
    return (
        EPISODES_SQL
        + f""",
exps AS (
  SELECT behavior_id, worker_id, agent_id, group_id, tick, next_tick, k, next_k, action, a0, value_est,
         next_value, episode, i // {horizon} AS segment, i, i % {horizon} AS j, r1 AS reward,
         g1 AS group_reward, d1 AS done, n1 AS interrupted,
         CASE WHEN d1 AND NOT n1 THEN 0.0::DOUBLE ELSE next_value END AS v_next
  FROM seq WHERE next_tick IS NOT NULL)"""
    )


def r(expr: str, digits: int = 4) -> str:
    """SQL twin of functions.numbers.steady."""
    s = 10**digits
    return f"(floor(CAST({expr} AS DOUBLE) * {s}.0::DOUBLE + 0.50001::DOUBLE) / {s}.0::DOUBLE)"
