"""Identifiers: behaviour, agent and group ids, metric names, pseudonyms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.numbers import as_col


def agent_gid(worker, agent) -> Column:
    return F.format_string("agent_%d-%d", as_col(worker), as_col(agent))


def group_gid(worker, group) -> Column:
    return F.format_string("group_%d-%d", as_col(worker), as_col(group))


def global_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("agent_gid", agent_gid("worker_id", "agent_id")).withColumn(
        "group_gid", group_gid("worker_id", "group_id")
    )


def behavior_name(c) -> Column:
    return F.split_part(as_col(c), F.lit("?"), F.lit(1))


def behavior_team(c) -> Column:
    """Team number; 0 when the id names none."""
    digits = F.regexp_extract(as_col(c), r"\?(?:.*&)?team=(\d+)", 1)
    return F.coalesce(F.when(digits != "", digits.cast("int")), F.lit(0))


def build_behavior_id(name, team) -> Column:
    return F.concat(as_col(name), F.lit("?team="), as_col(team).cast("string"))


def sanitize(c) -> Column:
    return F.translate(as_col(c), "/ ", ".")


def _padded_key(key: bytes, byte: int) -> Column:
    block = key.ljust(64, b"\0")
    return F.unhex(F.lit(bytes(b ^ byte for b in block).hex()))


def keyed_hash(c, key: str) -> Column:
    """HMAC-SHA256 in hex, from built-in functions."""
    import hashlib

    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    inner = F.sha2(F.concat(_padded_key(raw, 0x36), as_col(c).cast("binary")), 256)
    return F.sha2(F.concat(_padded_key(raw, 0x5C), F.unhex(inner)), 256)


def pseudonymise(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    return df.withColumns({c: keyed_hash(c, key) for c in cols})


def scope_runs(df: DataFrame) -> DataFrame:
    """Make behaviours of different runs distinct, for logs that hold several runs."""
    return df.withColumn("behavior_id", F.concat_ws("/", "run_id", "behavior_id"))
