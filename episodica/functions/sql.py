"""SQL names for the expressions: temporary SQL functions, which the optimizer inlines."""

from pyspark.sql import SparkSession

# Name, parameters and body of each function.
DEFINITIONS = (
    ("match_result", "r DOUBLE", "DOUBLE", "CASE WHEN r > 0 THEN 1D WHEN r < 0 THEN 0D ELSE 0.5D END"),
    ("behavior_name", "id STRING", "STRING", "split_part(id, '?', 1)"),
    (
        "behavior_team",
        "id STRING",
        "INT",
        "coalesce(try_cast(nullif(regexp_extract(id, 'team=([0-9]+)', 1), '') AS INT), 0)",
    ),
    ("agent_gid", "w INT, a BIGINT", "STRING", "format_string('agent_%d-%d', w, a)"),
    ("greedy_action", "q ARRAY<DOUBLE>", "BIGINT", "array_position(q, array_max(q)) - 1"),
    ("squash_action", "x DOUBLE", "DOUBLE", "greatest(least(x, 3D), -3D) / 3D"),
    ("imitation_reward", "d DOUBLE", "DOUBLE", "-ln(1D - d * (1D - 1e-7D))"),
    (
        "squared_distance",
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)",
    ),
    (
        "linear_decay",
        "s DOUBLE, hi DOUBLE, lo DOUBLE, last DOUBLE",
        "DOUBLE",
        "(hi - lo) * (1D - least(s, last) / last) + lo",
    ),
    (
        "expected_score",
        "own DOUBLE, other DOUBLE",
        "DOUBLE",
        "1D / (1D + power(10D, (other - own) / 400D))",
    ),
)


def register(spark: SparkSession) -> list[str]:
    for name, args, kind, body in DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return [d[0] for d in DEFINITIONS]
