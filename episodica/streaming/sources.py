"""Live step logs and how to drive a query over them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from episodica.plans.lineage import fresh_dir
from episodica.schema import STEPS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_steps(
    spark: SparkSession,
    path: str | None = None,
    fmt: str = "parquet",
    schema: T.StructType = STEPS,
    per_trigger: int | None = None,
    options: dict | None = None,
) -> DataFrame:
    """Steps of all workers as one stream.

    `per_trigger` is the back-pressure: files per micro-batch for a file source, offsets for a queue.
    It bounds what one key can bring into one task at a time.
    """
    reader = spark.readStream.format(fmt).options(**(options or {}))
    queue = fmt in ("kafka", "rate", "rate-micro-batch")
    if not queue:
        reader = reader.schema(schema)
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger" if queue else "maxFilesPerTrigger", per_trigger)
    return reader.load(path) if path else reader.load()


def run_available(stream: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what is there into parquet and return it as a table. Needs an append-mode plan."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = out or fresh_dir(spark, "stream-out")
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint or fresh_dir(spark, "stream-state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, handle, checkpoint: str | None = None, mode: str = "append") -> None:
    """Give every micro-batch to `handle(df, batch_id)` until the available data is processed."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint or fresh_dir(spark, "stream-state"))
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
