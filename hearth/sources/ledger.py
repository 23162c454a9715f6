"""The bill ledger at rest, in versions per period.

``data/fee_period=P/epoch=E`` holds period P as batch E left it; ``manifest/epoch=E`` names the periods that batch E
wrote, and is written last.  A batch reads and writes only the periods it touches.  The state before batch E is, per
period, the version of the latest manifest before E — so a batch that is tried again reads what it read the first time
and replaces its own files, and readers never see half a batch.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES

SPEC = TABLES["fee_records"]
FIRST = -1


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create(self, fees: DataFrame) -> None:
        """Write the starting ledger (epoch -1)."""
        self.write(fees, FIRST)

    def versions(self, before: int | None = None, periods: Iterable[str] | None = None) -> dict[str, int]:
        """Per period (default: all) the epoch of its current version, or of the one before batch ``before``; one row a period."""
        m = self.spark.read.schema("fee_period string, epoch bigint").parquet(f"{self.root}/manifest")
        if before is not None:
            m = m.where(F.col("epoch") < before)
        if periods is not None:
            m = m.where(F.col("fee_period").isin(list(periods)))
        return {r[0]: r[1] for r in m.groupBy("fee_period").agg(F.max("epoch")).collect()}

    def read(self, periods: Iterable[str] | None = None, before: int | None = None) -> DataFrame:
        """The bills of these periods (default: all); other periods' files are pruned by their folder's name."""
        data = self.spark.read.schema(", ".join(f"{c.name} {c.dtype}" for c in SPEC.columns) + ", epoch bigint").parquet(f"{self.root}/data")
        at: dict[int, list[str]] = {}
        for p, e in self.versions(before, periods).items():
            at.setdefault(e, []).append(p)
        wanted = reduce(lambda a, b: a | b, [(F.col("epoch") == e) & F.col("fee_period").isin(ps) for e, ps in at.items()], F.lit(False))
        return data.where(wanted).select(*SPEC.names)

    def write(self, fees: DataFrame, epoch: int) -> None:
        """Write the periods of ``fees``, whole, as their version of ``epoch``; tried again, it replaces its own files."""
        (fees.select(*SPEC.names).withColumn("epoch", F.lit(epoch).cast("bigint")).hint("rebalance", "fee_period")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fee_period", "epoch").parquet(f"{self.root}/data"))
        written = self.spark.read.schema("fee_period string, epoch bigint").parquet(f"{self.root}/data").where(F.col("epoch") == epoch)
        (written.select("fee_period").distinct().withColumn("of", F.lit(epoch).cast("bigint")).coalesce(1)
         .select("fee_period", F.col("of").alias("epoch")).write.mode("overwrite").parquet(f"{self.root}/manifest/batch={epoch}"))

    def vacuum(self, keep_from: int) -> list[str]:
        """Delete versions that no batch from ``keep_from`` on can ask for; returns their folders."""
        current = self.versions(keep_from)
        m = self.spark.read.schema("fee_period string, epoch bigint").parquet(f"{self.root}/manifest")
        gone = [(p, e) for p, e in (tuple(r) for r in m.where(F.col("epoch") < keep_from).select("fee_period", "epoch").distinct().collect()) if e < current[p]]
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        out = []
        for p, e in gone:
            name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(p)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/fee_period={name}/epoch={e}")
            path.getFileSystem(conf).delete(path, True)
            out.append(path.toString())
        return out
