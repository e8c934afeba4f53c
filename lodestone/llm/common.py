"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship  # noqa: F401
from . import elias_fano

#: Text bytes that one step of a vectorised worker loop holds at once.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one is set only where it is unset and Spark runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def cut(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and continue from there."""
    checkpoint_root(frame.sparkSession)
    return frame.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A new name in the shared checkpoint folder."""
    return uri(f"{checkpoint_root(spark).rstrip('/')}/table-{uuid.uuid4().hex}")


def written(frame: DataFrame, folder: str = "") -> DataFrame:
    """Write a frame as Parquet to the shared checkpoint folder and read it again; the files go when the driver ends."""
    spark = frame.sparkSession
    folder = folder or new_folder(spark)
    frame.write.option("compression", "zstd").parquet(folder)
    atexit.register(remove, folder)
    return spark.read.schema(frame.schema).parquet(folder)


def _give_back() -> None:
    """Return memory that a worker holds but doesn't use to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run):
    """run for mapInArrow, after which the worker gives unused memory back: it goes on to work on other stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return tidied


def map_by_place(frame: DataFrame, run, schema: T.StructType) -> DataFrame:
    """mapInArrow for frames whose columns may have any name: run gets and gives columns by their places."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema)])
    return frame.toDF(*(f"c{i}" for i in range(len(frame.columns)))).mapInArrow(run, plain).toDF(*schema.names)


def id_bucket(doc_id: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo buckets."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % buckets


def slices(batch: pa.RecordBatch, column: str | int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about limit bytes of the column (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def split_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)


def remove(folder: str) -> None:
    """Delete a folder of the shared one, if it is there."""
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    if system.get_file_info(path).type == pyarrow.fs.FileType.Directory:
        system.delete_dir(path)


def write(folder: str, name: str, raw: bytes) -> None:
    """Write a file of the shared folder as a whole, whoever writes it and how often."""
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(raw)
    system.move(own, f"{path}/{name}")


@lru_cache(maxsize=64)
def _listing(folder: str) -> frozenset[str]:
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    return frozenset(f.base_name for f in system.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True)))


@lru_cache(maxsize=4096)
def mapped(folder: str, name: str) -> dict[str, np.ndarray] | None:
    """A file of the shared folder, memory-mapped; None if there is none. From other stores than a mounted one it is
    copied to the worker's own disk, where only the mapping keeps it."""
    if name not in _listing(folder):
        return None
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    if isinstance(system, pyarrow.fs.LocalFileSystem):
        return elias_fano.load(f"{path}/{name}")
    import tempfile

    with tempfile.NamedTemporaryFile() as own:
        with system.open_input_stream(f"{path}/{name}") as source:
            while block := source.read(8_000_000):
                own.write(block)
        own.flush()
        return elias_fano.load(own.name)
