"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a document's hash. A bucket over the byte limit is split on one more bit,
and only such buckets; a shard is a bucket that fits. The directory is found from a histogram of bytes over hash
prefixes, pre-aggregated before its shuffle: about eight entries for a shard, so its size follows the number of shards,
not of documents. Buckets that are still too large at the end of the histogram get another one with more bits.

Cases: a document over the limit is never cut; it is a shard by itself (`<bits>:big`). Copies of one row share all bits;
where they exceed the limit together they are numbered and dealt to slices that fit. Null ids and texts hash like empty
ones. No rows, no shards. Columns of the input pass through whatever their names.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import cut, fresh_name, order_hash, text_of

BITS = 60
MORE_BITS = 12


def directory(sized: DataFrame, limit: int, depth: int) -> DataFrame:
    """(entry, bits, shard_bytes): for each `depth`-bit prefix the bucket it points to; null bits while it doesn't fit."""
    hist = sized.groupBy(F.shiftright("h", BITS - depth).alias("entry")).agg(F.sum("bytes").alias("b"))
    deep = hist.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    deep = deep.withColumn("bucket", F.expr(f"shiftright(entry, {depth} - bits)"))
    fits = deep.groupBy("bits", "bucket").agg(F.sum("b").alias("shard_bytes")).filter(F.col("shard_bytes") <= limit)
    found = deep.join(fits, ["bits", "bucket"], "left").withColumn(
        "leaf", F.when(F.col("shard_bytes").isNotNull(), F.struct("bits", "shard_bytes"))
    )
    return found.groupBy("entry").agg(F.min("leaf").alias("leaf")).select("entry", "leaf.bits", "leaf.shard_bytes")


def assign(sized: DataFrame, limit: int) -> DataFrame:
    """(the columns of sized, shard, bits, shard_bytes) for sized with h (60-bit hash) and bytes."""
    keep = sized.columns
    big = sized.filter(F.col("bytes") > limit).select(
        *keep, F.concat(F.col("h").cast("string"), F.lit(":big")).alias("shard"), F.lit(BITS).alias("bits"),
        F.col("bytes").alias("shard_bytes"),
    )
    rest = sized.filter(F.col("bytes") <= limit)
    total = rest.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 3)
    out = []
    while True:
        entries = cut(directory(rest, limit, depth), "directory")
        rows = rest.withColumn("entry", F.shiftright("h", BITS - depth)).join(entries, "entry")
        bucket = F.expr(f"shiftright(entry, {depth} - bits)")
        done = rows.filter(F.col("bits").isNotNull())
        out.append(done.select(*keep, F.concat("bits", F.lit(":"), bucket).alias("shard"), "bits", "shard_bytes"))
        if entries.filter(F.col("bits").isNull()).isEmpty():
            break
        rest = cut(rows.filter(F.col("bits").isNull()).select(*keep), "oversized")
        if depth == BITS:
            out.append(slices(rest, limit))
            break
        depth = min(BITS, depth + MORE_BITS)
    result = big
    for part in out:
        result = result.unionByName(part)
    return result


def slices(rest: DataFrame, limit: int) -> DataFrame:
    """Rows whose hashes are equal to the last bit, in slices that fit."""
    nth = F.row_number().over(Window.partitionBy("h", "bytes").orderBy("h")) - 1
    fit = F.greatest(F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))), F.lit(1))
    rows = rest.withColumn("_slice", F.floor(nth / fit))
    shard = F.concat_ws(":", F.lit(BITS), "h", "bytes", "_slice")
    sums = Window.partitionBy("h", "bytes", "_slice")
    return rows.select(*rest.columns, shard.alias("shard"), F.lit(BITS).alias("bits"), F.sum("bytes").over(sums).alias("shard_bytes"))


def plan_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, bytes, shard, bits, shard_bytes): the shard of each row; bytes counts the text in UTF-8."""
    text = text_of(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"), order_hash(F.col(id_col), text).alias("h"), F.octet_length(text).cast("long").alias("bytes")
    )
    return assign(cut(sized, "sized"), limit)


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs as one folder of Parquet for each shard."""
    h, shard = fresh_name(docs, "shard_hash"), fresh_name(docs, "shard")
    plan = plan_shards(docs, limit, id_col, text_col).groupBy("doc_id", "h", "shard").agg(F.count(F.lit(1)).alias("_rows"))
    # Copies of one row that went to several slices are dealt to them in turn.
    plan = plan.groupBy("h", "doc_id").agg(F.collect_set("shard").alias("_to"))
    plan = plan.select(F.col("h").alias("_h"), F.col("doc_id").alias("_id"), "_to")
    rows = docs.withColumn(h, order_hash(F.col(id_col), text_of(text_col)))
    rows = rows.join(plan, (F.col(h) == F.col("_h")) & F.col(id_col).eqNullSafe(F.col("_id")))
    turn = F.pmod(F.monotonically_increasing_id(), F.size("_to")).cast("int")
    rows = rows.withColumn(shard, F.element_at(F.sort_array("_to"), turn + 1)).drop("_h", "_id", "_to", h)
    rows.repartition(shard).write.partitionBy(shard).parquet(path)
