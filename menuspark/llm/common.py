"""What the operators of this subpackage share: text columns as bytes, staged tables, bounded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import new_folder, staged

#: The most bytes any operator here broadcasts; beyond it each takes its shuffled way.
BROADCAST_BYTES = 64 << 20


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string or binary column's values as UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what a step holds beside its input stays small. A task that has read its last gives
    the memory it has freed back to the system, as its worker may stay for other stages."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    release_memory()


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def join_counted(left: DataFrame, right: DataFrame, key: str, total: int, share: int = 1000, by: str = "n") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, where ``right`` has one row a key and in the column ``by`` how many of the ``total``
    rows of ``left`` have it. Keys with over 1/share of the rows are fewer than ``share``: those alone are broadcast, so no
    task gets a hot key; the others are joined by shuffle. ``by`` doesn't come out."""
    floor = total // share
    hot = F.broadcast(right.filter(F.col(by) > floor).drop(by))
    return left.join(hot, key).unionByName(left.join(hot, key, "left_anti").join(right.filter(F.col(by) <= floor).drop(by), key))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """For tasks that write or read files of their own: the file system of a URI, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri if ":" in uri.split("/")[0] else "file://" + uri))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(column, folds: int):
    """crc32 of a column's decimal text, modulo ``folds``."""
    return F.crc32(column.cast("string")) % folds


__all__ = ["BROADCAST_BYTES", "as_bytes", "crc_fold", "filesystem", "join_counted", "new_folder", "parts", "slices", "staged"]
