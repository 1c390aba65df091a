"""Text, JSON and YAML artefacts of training runs as tables."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.schema import STAT_EVENTS, STAT_METHODS


# --- metric events ---------------------------------------------------------------------------


def read_stat_events(
    spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False, unknown: str = "fail", per_trigger: int | None = None
) -> DataFrame:
    """Metric events, at rest or live. An aggregation method outside the known four fails the job, or with unknown="keep" goes on to
    `split_methods`; per_trigger is how many files a micro-batch of a stream admits."""
    reader = spark.readStream if stream else spark.read
    if stream and per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    events = reader.schema(STAT_EVENTS).format(fmt).load(path)
    return checked_methods(events) if unknown == "fail" else events


def known_method() -> Column:
    return F.coalesce(F.col("method").isin(*STAT_METHODS), F.lit(False))


def checked_methods(events: DataFrame) -> DataFrame:
    fail = F.raise_error(F.concat(F.lit("unknown aggregation method "), F.coalesce("method", F.lit("null"))))
    return events.withColumn("method", F.when(known_method(), F.col("method")).otherwise(fail.cast("string")))


def split_methods(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events of known methods, events put aside)."""
    return events.filter(known_method()), events.filter(~known_method())


# --- episode log -----------------------------------------------------------------------------


def parse_episode_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """`[time] [EPISODE END] reason=.. | mode=.. | ...` lines; other lines are left out."""
    text = F.col(value)
    body = F.regexp_extract(text, r"^\[([^\]]*)\] \[EPISODE END\] (.*)$", 2)
    pairs = F.str_to_map(body, F.lit(r" \| "), F.lit("="))
    parsed = lines.filter(text.contains("[EPISODE END]")).select(
        F.to_timestamp(F.regexp_extract(text, r"^\[([^\]]*)\]", 1), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        pairs.alias("p"),
    )
    p = F.col("p")
    # The line's field names.
    return parsed.select(
        "ts",
        p["reason"].alias("reason"),
        p["mode"].alias("mode"),
        p["totalSteps"].cast("long").alias("total_steps"),
        p["reward"].cast("double").alias("reward"),
        p["ptReaches"].cast("long").alias("reaches"),
        p["recharges"].cast("long").alias("recharges"),
        p["batteryAtEnd"].cast("double").alias("battery_at_end"),
        p["ptRate"].cast("double").alias("rate"),
        p["firstPtStep"].cast("long").alias("first_step"),
    )


def parse_episode_stats(lines: DataFrame, value: str = "value") -> DataFrame:
    """`[time] [EPISODE STATS] ptVisits=.. | ...` lines; other lines are left out."""
    text = F.col(value)
    body = F.regexp_extract(text, r"^\[([^\]]*)\] \[EPISODE STATS\] (.*)$", 2)
    parsed = lines.filter(text.contains("[EPISODE STATS]")).select(
        F.to_timestamp(F.regexp_extract(text, r"^\[([^\]]*)\]", 1), "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.str_to_map(body, F.lit(r" \| "), F.lit("=")).alias("p"),
    )
    p = F.col("p")
    # The line's field names.
    return parsed.select(
        "ts",
        p["mode"].alias("mode"),
        p["ptVisits"].cast("long").alias("pt_visits"),
        p["recharges"].cast("long").alias("recharges"),
        p["steps"].cast("long").alias("steps"),
        p["avgPtVisits"].cast("double").alias("mean_pt_visits"),
        p["avgRecharges"].cast("double").alias("mean_recharges"),
        p["eps"].cast("long").alias("episodes"),
    )


def read_episode_stats(spark: SparkSession, path: str) -> DataFrame:
    return parse_episode_stats(spark.read.text(path))


def read_episode_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_episode_log(spark.read.text(path))


# --- timer trees -----------------------------------------------------------------------------

SPANS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("total", T.DoubleType()),
        T.StructField("count", T.LongType()),
        T.StructField("is_parallel", T.BooleanType()),
        T.StructField("self_time", T.DoubleType()),
    ]
)


def parse_timer_trees(files: DataFrame, value: str = "value", source: str = "source") -> DataFrame:
    """One row per node of each JSON tree, with its path from the root."""

    def nodes(tree, path):
        open_nodes = [(path, tree)]
        while open_nodes:
            path, node = open_nodes.pop()
            yield path, node
            open_nodes += [([*path, name], child) for name, child in node.get("children", {}).items()]

    def run(batches):
        for pdf in batches:
            rows = []
            for src, text in zip(pdf[source], pdf[value]):
                tree = json.loads(text)
                for path, n in nodes(tree, [tree.get("name", "root")]):
                    rows.append((src, path, float(n["total"]), int(n["count"]), bool(n.get("is_parallel")), float(n.get("self", 0.0))))
            yield pd.DataFrame(rows, columns=SPANS.fieldNames())

    return files.select(source, value).mapInPandas(run, SPANS)


def read_timer_trees(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    return parse_timer_trees(files)


def parse_gauges(files: DataFrame, value: str = "value", source: str = "source") -> DataFrame:
    """Gauges a tree carries at its top level."""
    kind = "struct<gauges: map<string, struct<value: double, min: double, max: double, count: bigint>>>"
    return (
        files.select(source, F.from_json(value, kind).alias("t"))
        .select(source, F.explode("t.gauges").alias("name", "g"))
        .select(source, "name", "g.*")
    )


# --- training status -------------------------------------------------------------------------

# The fields of a checkpoint in a status file.
CHECKPOINT = (
    "struct<steps: bigint, file_path: string, reward: double, creation_time: double, "
    "auxillary_file_paths: array<string>>"
)


def parse_training_status(files: DataFrame, value: str = "value", source: str = "source") -> DataFrame:
    """(source, category, key, value): two levels of open JSON keys, values as text."""
    outer = F.from_json(value, "map<string, string>")
    return (
        files.select(source, F.explode(outer).alias("category", "_v"))
        .select(source, "category", F.explode(F.from_json("_v", "map<string, string>")).alias("key", "value"))
    )


def checkpoints_of(status: DataFrame) -> DataFrame:
    """The checkpoint list of each behaviour, one row per checkpoint."""
    return (
        status.filter(F.col("key") == "checkpoints")
        .select(F.col("category").alias("behavior"), F.explode(F.from_json("value", f"array<{CHECKPOINT}>")).alias("c"))
        .select("behavior", "c.*")
    )


def read_training_status(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    return parse_training_status(files)


# --- run configurations ----------------------------------------------------------------------

RUN_CONFIG = "run_id string, behavior string, key_path string, value string"


def parse_run_configs(files: DataFrame) -> DataFrame:
    """(path, content) -> long table; keys outside `behaviors` get behavior '*', lists keep their index."""
    names = ["run_id", "behavior", "key_path", "value"]

    def leaves(node, path):
        open_nodes = [(node, path)]
        while open_nodes:
            node, path = open_nodes.pop()
            if isinstance(node, dict) and node:
                open_nodes += [(v, [*path, str(k)]) for k, v in node.items()]
            elif isinstance(node, list) and node:
                open_nodes += [(v, [*path, str(n)]) for n, v in enumerate(node)]
            else:
                yield ".".join(path), None if node is None or node == {} or node == [] else str(node)

    def run(batches):
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                tree = yaml.load(bytes(content), loader) or {}
                for name, body in (tree.pop("behaviors", None) or {}).items():
                    rows += [(path, name, k, v) for k, v in leaves(body or {}, [])]
                rows += [(path, "*", k, v) for k, v in leaves(tree, [])] if tree else []
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, RUN_CONFIG)


def read_run_configs(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.y*ml").option("recursiveFileLookup", "true").load(path)
    return parse_run_configs(files)


def config_json(config: DataFrame) -> DataFrame:
    """One JSON document per (run, behaviour) for hand-over to analytics."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("key_path", "value"))))
    return config.groupBy("run_id", "behavior").agg(F.to_json(entries).alias("config"))
