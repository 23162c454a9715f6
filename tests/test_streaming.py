"""Payments arriving as two stream files give the same outcomes as two batch posts in a row."""

import os
import tempfile
from decimal import Decimal as D

from hearth.operators import billing as B
from hearth.streaming import apply_payment_stream, ledger_path, read_payment_stream


def test_two_micro_batches(spark, seed):
    root = tempfile.mkdtemp(prefix="hearth-stream-")
    src, led, out, ck = (os.path.join(root, x) for x in ("src", "ledger", "out", "ck"))
    fees = seed["fee_records"]
    fees.write.parquet(ledger_path(led, -1))
    first = [(8, 1, D("100.00")), (8, 2, D("200.00")), (9, 1, D("300.00"))]
    second = [(8, 3, D("149.50")), (8, 4, D("1.00")), (404, 1, D("5.00"))]
    ddl = "fee_id bigint, seq int, pay_amount decimal(10,2)"
    spark.createDataFrame(first, ddl).coalesce(1).write.parquet(os.path.join(src, "b1"))
    q = apply_payment_stream(read_payment_stream(spark, os.path.join(src, "*"), files_per_batch=1),
                             led, out, ck, as_of="2026-07-01 00:00:00")
    q.awaitTermination()
    spark.createDataFrame(second, ddl).coalesce(1).write.parquet(os.path.join(src, "b2"))
    q = apply_payment_stream(read_payment_stream(spark, os.path.join(src, "*"), files_per_batch=1),
                             led, out, ck, as_of="2026-07-01 00:00:00")
    q.awaitTermination()

    got = {(r["fee_id"], r["seq"]): r["reason"] for r in spark.read.parquet(os.path.join(out, "epoch=1")).collect()}
    assert got == {(8, 3): "OK", (8, 4): "ALREADY_PAID", (404, 1): "UNKNOWN_FEE"}
    final = {r["fee_id"]: (r["paid_amount"], r["status"]) for r in spark.read.parquet(ledger_path(led, 1)).collect()}
    assert final[8] == (D("249.50"), "已缴") and final[9] == (D("300.00"), "部分缴纳")
    expect = B.settle(B.settle(fees, spark.createDataFrame(first, ddl)), spark.createDataFrame(second, ddl))
    assert {r["fee_id"]: (r["paid_amount"], r["status"]) for r in expect.collect()} == final
