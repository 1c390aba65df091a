"""Step logs: the stored table, and the same table derived from a generic event log."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions.names import scope_runs
from episodica.schema import STEPS

# The event types, in the order of their discrete action index.
ACTIONS = ("click", "view", "signup", "error", "purchase")


def read_steps(spark: SparkSession, path: str, fmt: str = "parquet", several_runs: bool = False) -> DataFrame:
    """Typed scan of a step log; filters and column pruning reach the files.

    A log of several runs has agents of one name in each: their behaviours are then told apart by the run."""
    steps = spark.read.schema(STEPS).format(fmt).load(path)
    return scope_runs(steps) if several_runs else steps


def write_steps(steps: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    steps.write.mode(mode).partitionBy("behavior_id").format(fmt).save(path)


def event_columns() -> dict[str, Column]:
    """How an event row reads as a step."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    terminal = F.col("event_type") == "purchase"
    return {
        "tick": F.col("event_id"),
        "agent_id": F.col("user_id"),
        "worker_id": (F.col("user_id") % 4).cast("int"),
        "group_id": (F.col("user_id") % 10).cast("int"),
        "behavior_id": F.concat(
            F.lit("b"),
            (F.col("user_id") % 3).cast("string"),
            F.lit("?team="),
            (F.col("user_id") % 2).cast("string"),
        ),
        "k": k,
        "reward": F.col("value") / 100.0 - 0.5,
        "group_reward": k / 100.0,
        "value_est": k / 100.0,
        "is_terminal": terminal,
        "interrupted": terminal & (k % 4 == 0),
        "action": (F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("event_type")) - 1).cast(
            "int"
        ),
        "ts": F.col("ts"),
    }


def instant(df: DataFrame, c: str) -> Column:
    """A timestamp without zone counts as UTC, whatever the session's zone is."""
    if dict(df.dtypes)[c] != "timestamp_ntz":
        return F.col(c)
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(c)).cast("timestamp")


def steps_from_events(events: DataFrame, *columns: str) -> DataFrame:
    exprs = {**event_columns(), "ts": instant(events, "ts")}
    wanted = columns or tuple(exprs)
    return events.select(*[exprs[c].alias(c) for c in wanted])
