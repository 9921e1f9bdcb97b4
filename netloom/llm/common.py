"""Small helpers the operators share: table access, row keys, words, bounded caches."""

import contextlib
import ctypes
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
CACHE = 100_000  # entries a per-task word cache may hold before it starts again


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the number as text, modulo ``n``; null counts as empty text."""
    return (F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def raw(batch: pa.RecordBatch, name: str) -> list:
    """A string column as bytes objects; null is empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def trim():
    """Gives back what earlier tasks of this worker have freed: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


class Cache(dict):
    """word -> make(word), emptied when it holds ``CACHE`` entries, so a task's memory is bounded."""

    def __init__(self, make, most=CACHE):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        v = self[key] = self.make(key)
        return v


def crc(b: bytes) -> int:
    return zlib.crc32(b)
