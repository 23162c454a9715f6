"""Cutting long lineage through the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into ``spark.checkpoint.dir`` (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


class Rounds:
    """Tables of a loop, written as Parquet into ``spark.checkpoint.dir`` and read back.

    A checkpoint keeps the size Spark *estimated* for its plan; a loop that joins its own result squares that
    estimate every round.  A written table has its files' size, so the joins of every round are planned on it.
    ``keep`` deletes what earlier rounds wrote once their last reader is written.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.root = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *last: DataFrame) -> None:
        """Delete all tables but the ones ``last`` reads."""
        kept = [f for df in last for f in df.inputFiles()]
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        own = self.root.rsplit("/", 1)[1]                    # a scheme may be spelled in several ways
        for p in [p for k, p in enumerate(self.paths) if p and not any(f"/{own}/{k}/" in f for f in kept)]:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
            self.paths[self.paths.index(p)] = ""
