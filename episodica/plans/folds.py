"""Ordered folds: recurrences no window can express.

`ordered_fold` streams each key through a task in sorted Arrow batches with O(1) state; Spark's sort
spills, so a key never has to fit in memory. `threshold_resets` goes further: its recurrence is cut
into blocks that run in parallel, and only a small exact transfer table per block is read in order.
"""

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from episodica.plans.ordered import block_of, block_width, prefix, total_order


def python_partitions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash layout for a Python stage. A stated number keeps small inputs from being merged into one
    task: here rows cost time, not bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def ordered_fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    start: Callable[[], object],
    step: Callable[[object, tuple], Iterable[tuple]],
    schema: str | T.StructType,
) -> DataFrame:
    """Apply `step(state, row) -> output rows` along `order`, with a fresh `start()` state per key."""
    nk = len(keys)
    cols = [*keys, *[c for c in df.columns if c not in keys]]
    laid_out = python_partitions(df.select(*cols), keys).sortWithinPartitions(*keys, *order)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = schema.fieldNames()

    def run(batches):
        key, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name="Row"):
                if row[:nk] != key:
                    key, state = row[:nk], start()
                out.extend(step(state, row))
            yield pd.DataFrame(out, columns=names)

    return laid_out.mapInPandas(run, schema)


def _flushes(c: np.ndarray, last: int, limit: int) -> list[int]:
    hits = []
    while True:
        j = int(np.searchsorted(c, last + limit, side="right"))
        if j >= len(c):
            return hits
        hits.append(j)
        last = c[j]


def _transfer(c: np.ndarray, first_length: int, limit: int) -> tuple[list, list, list]:
    """For each reset that can be a block's first: (its running total, the last reset's, resets).

    A carried reset lies within `limit` of the block's start, so only rows within one more `limit` of
    it can come first.
    """
    n = len(c)
    after = np.searchsorted(c, c + limit, side="right")
    leads, hits = c.copy(), np.ones(n, dtype=np.int64)
    for j in range(n - 1, -1, -1):
        if after[j] < n:
            leads[j] = leads[after[j]]
            hits[j] = hits[after[j]] + 1
    start = c[0] - first_length
    reach = min(int(np.searchsorted(c, start + limit, side="right")) + 1, n)
    return c[:reach].tolist(), leads[:reach].tolist(), hits[:reach].tolist()


def _stretches(pdf: pd.DataFrame, cols: list[str]):
    """Consecutive rows with equal `cols`: (values, slice)."""
    n = len(pdf)
    if not n:
        return
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in cols:
        v = pdf[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new)
    for a, b in zip(starts, [*starts[1:], n]):
        yield tuple(pdf[c].iloc[a] for c in cols), pdf.iloc[a:b]


def threshold_resets(
    df: DataFrame, keys: list[str], position: str, length: str, limit: int, width: int | None = None
) -> DataFrame:
    """Number the rounds of "add up `length`; once the sum since the last reset exceeds `limit`, reset".

    Returns keys, the columns of the total order (position first), length, `total` (running sum),
    `round` (resets before the row) and `closes` (the row itself resets). Lengths are positive.

    Blocks of the order are independent but for the total at the last reset before them. Each block
    yields its exact table from that total to the one it hands on; the tables are read in order, and
    then all blocks number their rows in parallel.
    """
    limit = int(limit)
    width = block_width(df, width)
    bk = [*keys, "b"]
    order = total_order(df, keys, position)
    summed = prefix(
        df.select(*keys, *order, length), keys, position, {"total": F.col(length).cast("long")}, order, width=width
    )
    rows = python_partitions(summed.withColumn("b", block_of(position, width)), bk)
    kinds = {f.name: f.dataType for f in rows.schema}
    key_fields = [T.StructField(c, kinds[c]) for c in bk]
    longs = T.ArrayType(T.LongType())
    table_schema = T.StructType(list(key_fields)).add("at", longs).add("leads", longs).add("hits", longs)

    def tables(batches):
        # One block's totals at a time: at most `width` numbers.
        key, parts, first = None, [], 0
        for pdf in batches:
            out = []
            for k, piece in _stretches(pdf, bk):
                if k != key:
                    if parts:
                        out.append((*key, *_transfer(np.concatenate(parts), first, limit)))
                    key, parts, first = k, [], int(piece[length].iloc[0])
                parts.append(piece["total"].to_numpy(dtype=np.int64))
            yield pd.DataFrame(out, columns=table_schema.fieldNames())
        if parts:
            yield pd.DataFrame(
                [(*key, *_transfer(np.concatenate(parts), first, limit))], columns=table_schema.fieldNames()
            )

    def carry(state, row):
        last, done = state
        j = int(np.searchsorted(np.asarray(row.at), last + limit, side="right"))
        if j < len(row.at):
            state[0], state[1] = int(row.leads[j]), done + int(row.hits[j])
        return [(*row[: len(bk)], last, done)]

    ordered = rows.sortWithinPartitions(*bk, *order)
    starts = ordered_fold(
        ordered.mapInPandas(tables, table_schema),
        keys,
        ["b"],
        lambda: [0, 0],
        carry,
        T.StructType(list(key_fields)).add("_last", "long").add("_round0", "long"),
    )
    out_schema = T.StructType([T.StructField(c, kinds[c]) for c in [*keys, *order, length, "total"]])
    out_schema = out_schema.add("round", "long").add("closes", "boolean")

    def number(batches):
        key, last, done = None, 0, 0
        for pdf in batches:
            for k, piece in _stretches(pdf, bk):
                if k != key:
                    key, last, done = k, int(piece["_last"].iloc[0]), int(piece["_round0"].iloc[0])
                c = piece["total"].to_numpy(dtype=np.int64)
                hit = np.zeros(len(c), dtype=bool)
                at = _flushes(c, last, limit)
                hit[at] = True
                out = piece[[*keys, *order, length, "total"]].copy()
                out["round"] = done + np.cumsum(hit) - hit
                out["closes"] = hit
                if at:
                    last, done = int(c[at[-1]]), done + len(at)
                yield out

    joined = python_partitions(rows.join(starts, bk), bk).sortWithinPartitions(*bk, *order)
    return joined.mapInPandas(number, out_schema)
