"""Payment batches arriving as a stream, applied to the bill ledger per micro-batch.

Structured Streaming reads new payment files; ``foreachBatch`` runs the
batch job :func:`hearth.operators.billing.post_payments` against the ledger
version left by the previous micro-batch and writes, for epoch ``e``:

* ``{outcomes_root}/epoch=e`` — one outcome row per payment;
* ``{ledger_root}/epoch=e``   — the whole ledger after the batch.

Both are overwritten by a retried epoch, so a micro-batch that is re-run
after a failure gives the same files (the sink is idempotent per epoch).
The initial ledger is expected at ``{ledger_root}/epoch=-1``.

:func:`apply_payment_stream_by_period` keeps the ledger in versions per period instead (:mod:`hearth.sources.ledger`): its
payments name their bill's period, and a micro-batch reads and writes only the periods it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.billing import MONEY, UNKNOWN_FEE, post_payments, settle
from ..plans.lineage import cut_lineage
from ..schemas import TABLES
from ..sources.ledger import Ledger

PAYMENT_SCHEMA = "fee_id bigint, seq int, pay_amount decimal(10,2)"


def ledger_path(ledger_root: str, epoch: int) -> str:
    return f"{ledger_root}/epoch={epoch}"


def read_payment_stream(spark: SparkSession, source_dir: str, files_per_batch: int | None = None,
                        schema: str = PAYMENT_SCHEMA) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(source_dir)


def apply_payment_stream(payments: DataFrame, ledger_root: str, outcomes_root: str, checkpoint_location: str,
                         as_of=None, available_now: bool = True) -> StreamingQuery:
    """Start the stream; each micro-batch posts its payments against the previous ledger version."""
    spark = payments.sparkSession
    schema = TABLES["fee_records"].spark_schema

    def per_batch(batch: DataFrame, epoch: int) -> None:
        fees = spark.read.schema(schema).parquet(ledger_path(ledger_root, epoch - 1))
        post_payments(fees, batch).write.mode("overwrite").parquet(f"{outcomes_root}/epoch={epoch}")
        settle(fees, batch, as_of).write.mode("overwrite").parquet(ledger_path(ledger_root, epoch))

    w = payments.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


PERIOD_PAYMENT_SCHEMA = "fee_id bigint, fee_period string, seq int, pay_amount decimal(10,2)"


def post_by_period(ledger: Ledger, payments: DataFrame, epoch: int, as_of=None) -> tuple[DataFrame, DataFrame]:
    """``outcomes, bills`` of one batch against the ledger before ``epoch``; only the periods the payments name are read.

    A payment whose bill is not in the period it names is refused as ``UNKNOWN_FEE``."""
    payments = cut_lineage(payments)
    periods = [r[0] for r in payments.select("fee_period").where("fee_period is not null").distinct().collect()]   # one row a period
    fees = ledger.read(periods, before=epoch)
    known = fees.select("fee_id", "fee_period")
    mine = payments.join(known, ["fee_id", "fee_period"], "left_semi").select("fee_id", "seq", "pay_amount")
    lost = payments.join(known, ["fee_id", "fee_period"], "left_anti")
    outcomes = post_payments(fees, mine).unionByName(lost.select(
        "fee_id", "seq", F.col("pay_amount").cast(MONEY).alias("pay_amount"), F.lit(UNKNOWN_FEE).alias("reason"),
        F.lit(None).cast(MONEY).alias("paid_after"), F.lit(None).cast("string").alias("status_after")))
    return outcomes, settle(fees, mine, as_of)


def apply_payment_stream_by_period(payments: DataFrame, ledger: Ledger, outcomes_root: str, checkpoint_location: str,
                                   as_of=None, available_now: bool = True) -> StreamingQuery:
    """Start the stream; a micro-batch rewrites the periods its payments name and no others."""
    def per_batch(batch: DataFrame, epoch: int) -> None:
        outcomes, bills = post_by_period(ledger, batch, epoch, as_of)
        outcomes.write.mode("overwrite").parquet(f"{outcomes_root}/epoch={epoch}")
        ledger.write(bills, epoch)

    w = payments.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
