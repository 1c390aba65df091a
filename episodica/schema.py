"""Table schemas shared by sources, operators and streams."""

from pyspark.sql import types as T

ACTION = T.StructType(
    [
        T.StructField("continuous", T.ArrayType(T.FloatType())),
        T.StructField("discrete", T.ArrayType(T.IntegerType())),
    ]
)

STEPS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("behavior_id", T.StringType()),
        T.StructField("worker_id", T.IntegerType()),
        T.StructField("agent_id", T.LongType()),
        T.StructField("tick", T.LongType()),
        T.StructField("group_id", T.IntegerType()),
        T.StructField("obs", T.ArrayType(T.ArrayType(T.FloatType()))),
        T.StructField("action", ACTION),
        T.StructField("action_mask", T.ArrayType(T.ArrayType(T.BooleanType()))),
        T.StructField("reward", T.FloatType()),
        T.StructField("group_reward", T.FloatType()),
        T.StructField("is_terminal", T.BooleanType()),
        T.StructField("interrupted", T.BooleanType()),
        T.StructField("value_est", T.DoubleType()),
        T.StructField("log_prob", T.ArrayType(T.FloatType())),
        T.StructField("ts", T.TimestampType()),
    ]
)

STAT_EVENTS = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("method", T.StringType()),
        T.StructField("worker_id", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

# How a statistic may be aggregated, in wire-number order.
STAT_METHODS = ("AVERAGE", "MOST_RECENT", "SUM", "HISTOGRAM")

# One agent's stream of steps; every per-agent operator partitions on these.
AGENT = ["behavior_id", "worker_id", "agent_id"]
# One trajectory: bounded by the horizon, whatever the agent's total size.
TRAJECTORY = [*AGENT, "episode", "segment"]
GROUP = ["behavior_id", "worker_id", "group_id"]
