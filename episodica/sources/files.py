"""Files written from rows: artefacts that other programs read."""

import re

import pyarrow as pa
from pyspark.sql import DataFrame


def store_of(path: str):
    """(file system, path within it) of a path as Spark names it."""
    from pyarrow import fs

    if ":" not in path.split("/")[0]:
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def write_files(files: DataFrame, folder: str) -> int:
    """Writes (name, content) rows as files of a folder, whole contents at a time; a task that runs again writes the same files. Returns their number."""
    store, inner = store_of(folder)
    store.create_dir(inner, recursive=True)

    def write(batches):
        store, inner = store_of(folder)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                with store.open_output_stream(f"{inner}/{name}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    return files.select("name", files["content"].cast("binary").alias("content")).mapInArrow(write, "name string").count()
