"""Pieces shared by the corpus operators: table access, Arrow maps and files in the shared folder."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from wattloom.session import cut_lineage, scratch_path, ship_package

#: Rows in one Arrow batch of whole texts; together with the byte limit it bounds what a Python worker holds.
TEXT_ROWS = 1000
TEXT_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound the Arrow batches of the session."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


_IN_USE: dict[str, Callable[[], None]] = {}


def take_memory(owner: str, clear: Callable[[], None]) -> None:
    """Keep what one operator remembers between tasks: a worker that serves another one first drops what it held before."""
    if others := [o for o in _IN_USE if o != owner]:
        for other in others:
            _IN_USE.pop(other)()
        give_back()
    _IN_USE[owner] = clear


def give_back() -> None:
    """Return free memory to the system: workers live on between tasks, and executors count what they hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Map Arrow batches; ``make`` runs once in each task and returns the function for its batches."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if (out := step(batch)) is not None and out.num_rows:
                yield out
        give_back()

    return df.mapInArrow(run, schema)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and no executor is needed for it later."""
    return cut_lineage(df, name)


def new_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class OneFile:
    """A file that appears under its name only when complete, so that a repeated task leaves one whole copy."""

    def __init__(self, folder: str, name: str):
        self.store, base = open_store(folder)
        self.store.create_dir(base, recursive=True)
        self.final = f"{base}/{name}"
        self.part = f"{base}/.{name}.{os.getpid()}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.part)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Append and return the offset of the data."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.store.move(self.part, self.final)


def strings(column: pa.Array) -> list[str | None]:
    return column.to_pylist()
