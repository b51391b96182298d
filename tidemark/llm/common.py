"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words, in every operator that counts or shingles words.
WORD_GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def materialise(df: DataFrame, partition_by: list[str] | None = None, compressed: bool = True) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and a lost executor costs no recomputation. What is packed already need not be compressed."""
    path = shared_folder(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if not compressed:
        writer = writer.option("compression", "none").option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name in taken:
        name = f"_{name}"
    return name


def with_fields(df: DataFrame, **types: T.DataType) -> T.StructType:
    """The table's schema with further fields, for a function on its batches; a column of such a name must be dropped before."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in types.items())])


def fold_mod(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def hash_bound(limit: int, rows: int) -> int:
    """A bound on xxhash64 that several times `limit` of so many rows stay below: what is sorted for a sample then doesn't grow with the table."""
    share = min(1.0, max(4 * limit, limit + 1000) / max(rows, 1))
    return min(2**63 - 1, int(-(2**63) + share * 2**64))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. A text of one-byte characters has no other upper case, so lower() does there."""
    one_byte = F.octet_length(text) == F.char_length(text)
    return F.when(one_byte, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


_KEPT: dict[str, dict] = {}


def kept(kind: str) -> dict:
    """What tasks of this kind leave in a worker for those after them."""
    return _KEPT.setdefault(kind, {})


def forget(others_than: str | None = None) -> None:
    for kind in [k for k in _KEPT if k != others_than]:
        del _KEPT[kind]


def give_back() -> None:
    """Hand freed memory to the system, where the allocators know how."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def lean(run: Callable[[Batches], Batches], keep: str | None = None) -> Callable[[Batches], Batches]:
    """A function on batches for workers that live through many stages: it begins without what other kinds of tasks keep, and gives back what it freed at its end."""

    def own(batches: Batches) -> Batches:
        forget(keep)
        try:
            yield from run(batches)
        finally:
            give_back()

    return own
