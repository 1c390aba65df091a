"""Token-id output: documents packed into rows of one length, as training reads them.

Overlong documents are split losslessly: full rows first, then the rest as one segment. Segments shorter than a row are
packed best-fit-decreasing: longest first, each into the open row with the least room that still takes it, which a
segment tree over capacities finds in a number of steps that is the logarithm of the row length. A packed row holds its ids, the
cumulative segment lengths (where attention must not cross) and positions that start anew with each segment.

Documents are dealt to groups by hash and packed in windows of a bounded number of tokens within a group, so memory
follows neither the corpus nor any key, and the same documents are packed alike on every run.

Cases: a null or empty text has no tokens and no segment; repeated rows and null ids are packed like others, in a fixed
order; an empty table gives no rows; other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from episodica.llm.bpe import codec_of, shared, vocabulary
from episodica.llm.common import order_hash, text_of

ROW_TOKENS = 2048
WINDOW_TOKENS = 1 << 20
GROUP_BYTES = 16 << 20

ROWS = pa.schema(
    [("group", pa.int64()), ("window", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()),
     ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())),
     ("ids", pa.binary()), ("positions", pa.binary())]
)


class Capacities:
    """Open rows by the room they have left; a segment tree counts them, so that the tightest fit is found at once."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self.change(room, 1)

    def change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room of at least `need`; it is no longer open."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not self.count[node]:
                    node += 1
        room = node - self.leaves
        self.change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Segments in rows of `size`: lists of indices. Equal lengths keep their order."""
    rows: list[list[int]] = []
    tree = Capacities(size)
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[k])
        if found is None:
            found = size, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(k)
        if room > lengths[k]:
            tree.add(room - lengths[k], row)
    return rows


def pack_window(docs: list[tuple[int | None, np.ndarray]], size: int, pad: int) -> list[dict]:
    """Packed rows of (id, token ids) documents."""
    segments = [(d, s) for d, (_, ids) in enumerate(docs) for s in range(0, len(ids), size)]
    lengths = [min(size, len(docs[d][1]) - s) for d, s in segments]
    out = []
    for own in best_fit_decreasing(lengths, size):
        sizes = np.array([lengths[k] for k in own])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.full(size, pad, docs[0][1].dtype)
        places = np.zeros(size, np.int32)
        for k, a, b in zip(own, edges[:-1].tolist(), edges[1:].tolist()):
            d, s = segments[k]
            ids[a:b] = docs[d][1][s : s + b - a]
            places[a:b] = np.arange(b - a)
        out.append({
            "row": len(out), "n_tokens": int(edges[-1]), "doc_ids": [docs[segments[k][0]][0] for k in own],
            "doc_starts": [segments[k][1] for k in own], "cu_seqlens": edges.tolist(), "ids": ids.tobytes(),
            "positions": places.tobytes(),
        })
    return out


def id_type(n_ids: int) -> np.dtype:
    """The narrowest unsigned integer that also holds a padding id."""
    return np.dtype("<u2" if n_ids < 1 << 16 else "<u4")


def token_bytes(spark: SparkSession, text: Column, path: str) -> Column:
    """The ids of each text as little-endian integers of id_type."""
    tables, kind = shared(spark, path), id_type(vocabulary(path).n_ids)

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = codec_of(*tables.value)
        for batch in batches:
            pieces, sizes = [], np.zeros(len(batch), np.int64)
            for i, ids, bounds, _ in codec.parts(batch):
                pieces.append(ids.astype(kind))
                sizes[i : i + len(bounds) - 1] += np.diff(bounds)
            at = (np.concatenate([[0], np.cumsum(sizes)]) * kind.itemsize).astype(np.int64)
            data = np.concatenate([np.zeros(0, kind), *pieces])
            buffers = [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())]
            yield pa.Array.from_buffers(pa.large_binary(), len(batch), buffers).cast(pa.binary())

    return F.arrow_udf(encoded, "binary")(text)


def pack(docs: DataFrame, path: str, size: int = ROW_TOKENS, pad: int | None = None, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW_TOKENS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Packed rows: group, window and row name a row; ids and positions hold `size` little-endian integers."""
    spark, text = docs.sparkSession, text_of(text_col)
    n_ids = vocabulary(path).n_ids
    kind, filler = id_type(n_ids), n_ids if pad is None else pad
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(0, int(total // group_bytes)).bit_length()
    key = order_hash(F.col(id_col), text)
    tokens = docs.select(F.shiftright(key, 60 - bits).alias("group"), key.alias("key"), F.col(id_col).cast("long").alias("doc_id"),
                         token_bytes(spark, text, path).alias("ids"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, group, n = [], 0, None, 0
        for batch in batches:
            for g, doc, ids in zip(batch["group"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"]):
                if waiting and (g != group or held >= window):
                    yield rows_of(waiting, group, n)
                    waiting, held, n = [], 0, n + 1
                if g != group:
                    group, n = g, 0
                waiting.append((doc, np.frombuffer(ids.as_buffer(), kind).copy()))
                held += len(waiting[-1][1])
        if waiting:
            yield rows_of(waiting, group, n)

    def rows_of(waiting: list, group: int, n: int) -> pa.RecordBatch:
        rows = [r | {"group": group, "window": n} for r in pack_window(waiting, size, filler)]
        return pa.RecordBatch.from_pylist(rows, schema=ROWS)

    dealt = tokens.repartition("group").sortWithinPartitions("group", "key", "doc_id")
    return dealt.mapInArrow(packed, from_arrow_schema(ROWS))


def write_packed(docs: DataFrame, folder: str, path: str, **options) -> None:
    """Writes the packed rows as Parquet."""
    pack(docs, path, **options).write.parquet(folder)
