"""Folders that all executors of a cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this name, not used before, below ``spark.checkpoint.dir``; where that is unset on one machine, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='parley-')}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_files(rows: DataFrame, folder: str, suffix: str) -> None:
    """One file for each row (name, content as bytes), written by the tasks. Spark names its own files, so each is written under
    another name and moved into place: it is there whole or not at all, also when a task runs twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        place.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                draft = f"{root}/.{name}-{uuid.uuid4().hex}"
                with place.open_output_stream(draft) as out:
                    out.write(content)
                place.move(draft, f"{root}/{name}{suffix}")
            yield batch.select(["name"])

    rows.select("name", "content").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()
