"""Spark session settings the jobs are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings that matter at cluster scale; a cluster's own spark-defaults win where they are set.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",                    # runtime re-plan on real sizes
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",           # split a hot resident / bill key
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",  # broadcast only what measured small
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.maxMetadataStringLength": "1000",             # plans name a scan's filters whole
}


# Partition sizing for a cluster reading ~100 TB: start shuffles wide and let AQE coalesce them to
# the advisory size, so no reducer holds more than it can sort in memory; scans split at 256 MB.
CLUSTER_DEFAULTS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16384",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512MB",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def _given_settings() -> set[str]:
    """Settings that the cluster has made already: a running session's, or spark-defaults.conf's."""
    import os

    import pyspark
    active = SparkSession.getActiveSession()
    if active is not None:
        return {k for k, _ in active.sparkContext.getConf().getAll()}
    home = os.environ.get("SPARK_CONF_DIR") or os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "conf")
    path = os.path.join(home, "spark-defaults.conf")
    if not os.path.exists(path):
        return set()
    with open(path) as f:
        return {x.replace("=", " ", 1).split()[0] for x in f if x.strip() and not x.lstrip().startswith("#")}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "hearth", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    given = _given_settings()
    own = DEFAULTS if master is not None and master.startswith("local") else DEFAULTS | CLUSTER_DEFAULTS
    for k, v in own.items():
        if k not in given:
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the cluster's ``spark.checkpoint.dir`` when set.

    Only when nothing is configured (a laptop or a test) is a private scratch folder made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor shares")
        conf = tempfile.mkdtemp(prefix="hearth-ckpt-")     # single-machine runs and tests only
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers: zip it once per application and hand it to
    ``addPyFile`` (Spark serves it to every executor).  Harmless where it is installed already."""
    import os
    import zipfile
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    # staged on the driver only: addPyFile itself serves the file to every executor (no data here)
    out = os.path.join(tempfile.mkdtemp(prefix="hearth-code-"), f"hearth-{app}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("hearth", os.path.relpath(full, pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)
