"""Demonstration files by ranges of records, so that one large file fills several tasks.

Records follow each other with their lengths before them; where one begins is known only from the one before. A walk over these lengths reads a file's
header and a few bytes a record, and cuts it into ranges of about `split` bytes; files up to that size are one range and aren't walked. `demo_ranges`
walks in tasks, one a file at a time, and `decode_ranges` reads nothing but its range of a file. The catalogue reads heads only.

`spark.read.format("demonstrations")` is the same as a data source: its partitions are packs of ranges. It plans on the driver, so it is for
sets whose large files are few; `read_demos` plans in tasks.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from episodica.plans.folds import python_partitions
from episodica.sources.demos import (
    CATALOG, DEMO_STEPS, ROWS_PER_BATCH, SPEC_AT, checked_version, delimited, demo_files, parse_meta, parse_record, parse_spec, record_batch, varint,
)
from episodica.sources.files import store_of

SPLIT = 64 << 20
WINDOW = 1 << 16
RANGES = "path string, behavior_id string, first long, n long, at long, stop long"
LONGEST_VARINT = 10


class Window:
    """Bytes of a file by position, read in blocks."""

    def __init__(self, path: str):
        store, inner = store_of(path)
        self.file = store.open_input_file(inner)
        self.size = self.file.size()
        self.start, self.held = 0, b""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def read(self, at: int, n: int) -> bytes:
        if at < self.start or at + n > self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, WINDOW))
        return self.held[at - self.start : at - self.start + n]

    def length(self, at: int) -> tuple[int, int]:
        """(length, where its message begins) of the message whose length stands at `at`."""
        n, size = varint(self.read(at, LONGEST_VARINT), 0)
        return n, at + size

    def message(self, at: int) -> tuple[bytes, int]:
        n, at = self.length(at)
        return self.read(at, n), at + n

    def head(self) -> tuple[dict, dict, int]:
        """(metadata, action spec, where the records begin)."""
        meta = checked_version(parse_meta(self.message(0)[0]))
        if self.size <= SPEC_AT:
            raise ValueError("no behavior parameters in demonstration file")
        raw, at = self.message(SPEC_AT)
        return meta, parse_spec(raw), at


def ranges(path: str, split: int) -> Iterator[tuple]:
    """Rows of RANGES for one file: no records beyond the declared number of steps."""
    with Window(path) as w:
        meta, spec, at = w.head()
        name, steps = spec["behavior_id"], meta["number_steps"]
        if w.size - at <= split:
            yield path, name, 0, steps, at, w.size
            return
        first, start, n = 0, at, 0
        while at < w.size and n < steps:
            if at - start >= split:
                yield path, name, first, n - first, start, at
                first, start = n, at
            length, at = w.length(at)
            at, n = at + length, n + 1
        if n > first:
            yield path, name, first, n - first, start, min(at, w.size)


def range_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Steps of the records in ranges."""
    schema, held = to_arrow_schema(DEMO_STEPS), []
    for path, name, first, n, at, stop in rows:
        store, inner = store_of(path)
        with store.open_input_file(inner) as f:
            f.seek(at)
            content = f.read(stop - at)
        here = 0
        for tick in range(first, first + n):
            if here >= len(content):
                break
            raw, here = delimited(content, here)
            held.append({"path": path, "tick": tick, "behavior_id": name, **parse_record(raw)})
            if len(held) >= ROWS_PER_BATCH:
                yield record_batch(held, schema)
                held = []
    yield record_batch(held, schema)


def demo_ranges(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path) -> RANGES."""
    schema = pa.schema([("path", pa.string()), ("behavior_id", pa.string()), *[(c, pa.int64()) for c in ("first", "n", "at", "stop")]])

    def walk(batches):
        for batch in batches:
            rows = [r for path in batch.column("path").to_pylist() for r in ranges(path, split)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    return python_partitions(files.select("path"), ["path"]).mapInArrow(walk, RANGES)


def decode_ranges(found: DataFrame) -> DataFrame:
    """Ranges, dealt to all tasks, as demo steps."""

    def run(batches):
        yield from range_batches(tuple(r.values()) for batch in batches for r in batch.to_pylist())

    return python_partitions(found, ["path", "at"]).mapInArrow(run, DEMO_STEPS)


def read_demos(spark: SparkSession, path: str | list[str], split: int = SPLIT) -> DataFrame:
    """The records of a .demo file, of a folder's files or of several folders', as one table."""
    return decode_ranges(demo_ranges(demo_files(spark, path), split))


def demo_catalog(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Metadata, action spec and first observation shapes per file, from the files' heads."""
    schema = to_arrow_schema(CATALOG)

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                with Window(path) as w:
                    meta, spec, at = w.head()
                    shapes = parse_record(w.message(at)[0])["shapes"] if at < w.size else []
                rows.append({"path": path, **meta, **spec, "shapes": shapes})
            yield record_batch(rows, schema)

    return python_partitions(demo_files(spark, path).select("path"), ["path"]).mapInArrow(run, CATALOG)


class Pack(InputPartition):
    """Ranges that one task reads."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows


class Demonstrations(DataSource):
    """spark.read.format("demonstrations").option("split", bytes).load(path)"""

    @classmethod
    def name(cls) -> str:
        return "demonstrations"

    def schema(self):
        return DEMO_STEPS

    def reader(self, schema):
        return DemonstrationReader(self.options["path"], int(self.options.get("split", SPLIT)))


class DemonstrationReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def files(self) -> list[str]:
        from pyarrow import fs

        store, inner = store_of(self.path)
        found = store.get_file_info(inner)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no demonstration file or folder at {self.path}")
        if found.type == fs.FileType.File:
            names = [inner]
        else:
            names = sorted(x.path for x in store.get_file_info(fs.FileSelector(inner, recursive=True)) if x.type == fs.FileType.File)
        names = [x for x in names if x.endswith(".demo")]
        if not names:
            raise ValueError(f"no .demo file at {self.path}")
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path and not self.path.startswith("file:") else ""
        return [scheme + x for x in names]

    def partitions(self):
        packs, held, size = [], [], 0
        for path in self.files():
            for row in ranges(path, self.split):
                held.append(row)
                size += row[-1] - row[-2]
                if size >= self.split:
                    packs.append(Pack(held))
                    held, size = [], 0
        return [*packs, Pack(held)] if held or not packs else packs

    def read(self, partition: Pack):
        yield from range_batches(partition.rows)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Demonstrations)
