"""Readers and writers: Parquet at rest, JSON for API-style results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES
from .derived import BASE_SCHEMAS, BASE_TABLES, LazyTables, derive_estate


def read_base(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> LazyTables:
    """The provided tables, one Parquet file each (``{sf_dir}/{name}.parquet``), opened on first use."""
    def opener(n):
        reader = spark.read.schema(BASE_SCHEMAS[n]) if n in BASE_SCHEMAS else spark.read
        return lambda: reader.parquet(f"{sf_dir}/{n}.parquet")
    return LazyTables({n: opener(n) for n in names})


def load_estate(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Estate tables derived from the provided tables in ``sf_dir`` (lazy)."""
    return derive_estate(spark, read_base(spark, sf_dir))


# fee_records is by far the largest table and fee_period its usual filter: partition on it.
PARTITION_COLUMNS = {"fee_records": ["fee_period"]}


def write_table(df: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    parts = PARTITION_COLUMNS.get(name)
    if parts:
        # REBALANCE: files grouped by period, but AQE splits a period too big for one task
        # (a plain repartition on the period would write a whole month from one task).
        df.hint("rebalance", *parts).write.mode(mode).partitionBy(*parts).parquet(f"{path}/{name}")
    else:
        df.write.mode(mode).parquet(f"{path}/{name}")


def write_estate(tables, path: str, mode: str = "overwrite", parallel: int = 4) -> None:
    """Write each table to ``{path}/{table}`` as Parquet (bills partitioned by period).

    The tables are independent jobs, submitted from a few driver threads so the
    cluster runs them side by side instead of one after another.
    """
    from concurrent.futures import ThreadPoolExecutor
    names = list(tables)
    frames = {n: tables[n] for n in names}          # plan on the calling thread
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        for f in [pool.submit(write_table, frames[n], path, n, mode) for n in names]:
            f.result()


def read_estate(spark: SparkSession, path: str, names=None) -> LazyTables:
    """Read estate tables written by :func:`write_estate`, with the declared schemas (no inference)."""
    def opener(name):
        t = TABLES[name]
        return lambda: spark.read.schema(t.spark_schema).parquet(f"{path}/{name}").select(*t.names)
    return LazyTables({n: opener(n) for n in names or TABLES})


def append_rows(df: DataFrame, path: str, table: str | None = None) -> None:
    """Append a batch to a table directory (S3)."""
    parts = PARTITION_COLUMNS.get(table or "")
    w = df.write.mode("append")
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON text per row: ISO dates, exact decimals, nulls kept, non-ASCII kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
