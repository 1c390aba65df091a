"""Replay tables on disk, one folder per behaviour."""

from pyspark.sql import DataFrame, SparkSession

# Fixed value: a stored column whose name carries an old spelling.
OLD_NAMES = {"group_discrete_aaction": "group_discrete_action"}


# Under this key a stored column's metadata holds the name it loads with.
NAME = "replay_name"


def stored_names(columns: list[str]) -> dict[str, str]:
    """Names without colons, which folders and files can hold; a name that is taken gets underscores."""
    taken, out = set(columns), {}
    for c in columns:
        if ":" in c:
            stored = c.replace(":", "__")
            while stored in taken:
                stored += "_"
            taken.add(stored)
            out[c] = stored
    return out


def save_replay(df: DataFrame, path: str, codec: str = "zstd", mode: str = "overwrite") -> None:
    """Keys of the form prefix:suffix are stored as prefix__suffix; their own names stand in the columns' metadata."""
    stored = stored_names(df.columns)
    renamed = df.withColumnsRenamed(stored)
    for own, name in stored.items():
        renamed = renamed.withMetadata(name, {**df.schema[own].metadata, NAME: own})
    renamed.write.mode(mode).option("compression", codec).partitionBy("behavior_id").parquet(path)


def load_replay(spark: SparkSession, path: str, behavior: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if behavior is not None:
        df = df.filter(df["behavior_id"] == behavior)
    names = {f.name: f.metadata[NAME] for f in df.schema if NAME in f.metadata}
    return df.withColumnsRenamed(names | {o: n for o, n in OLD_NAMES.items() if o in df.columns})
