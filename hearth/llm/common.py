"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever else the table holds, under their plain types."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_hash() -> Column:
    """Tells rows of one ``doc_id`` apart by their text."""
    text = F.col("text").cast("string")
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str, options: dict | None = None) -> None:
    """Write ``df`` as Parquet; Spark deletes the shuffle files of this one execution when it has ended."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)


def staged(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the folder named by ``spark.checkpoint.dir`` and read it back.

    The result survives lost executors and is never computed twice, and Spark plans what follows
    on the sizes of real files.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _write(df, path, options)
    return spark.read.schema(df.schema).parquet(path)


class Stages:
    """Tables that one job writes on its way; each can be deleted once its last reader is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = ensure_checkpoint_dir(spark).rstrip("/")
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = f"{self.root}/{name}-{uuid.uuid4().hex}"
        _write(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        sc = self.spark.sparkContext
        for name in names:
            path = sc._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn(table of one batch) -> table or None``; the package is shipped first."""
    ship_package(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def slices(b: pa.RecordBatch, column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that one slice holds about ``max_bytes`` of ``column`` (one row at least)."""
    col = b.column(b.schema.get_field_index(column))
    size = np.zeros(b.num_rows, dtype=np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if pa.types.is_large_string(col.type) or
                        pa.types.is_large_binary(col.type) else np.int32)[col.offset:col.offset + b.num_rows + 1]
    size[:] = np.diff(off)
    part = np.cumsum(size) // max_bytes
    cuts = np.flatnonzero(np.diff(part)) + 1
    start = 0
    for c in [*cuts.tolist(), b.num_rows]:
        if c > start:
            yield b.slice(start, c - start)
        start = c


#: One byte per byte: A-Z lowered, every ASCII byte that is no letter or digit made a space.
WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and all non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split() if text else []
