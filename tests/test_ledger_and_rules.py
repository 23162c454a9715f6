"""The ledger in versions per period, rules kept up to date by batches, small reports."""

import json
import os
import random
import tempfile
from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from hearth import schemas as S
from hearth.operators import billing as B
from hearth.operators import integrity as I
from hearth.operators import integrity_delta as V
from hearth.operators import reports as R
from hearth.sources.ledger import Ledger
from hearth.streaming import PERIOD_PAYMENT_SCHEMA, apply_payment_stream_by_period, post_by_period, read_payment_stream


def rows(df):
    return sorted(map(str, df.collect()))


def files(root):
    return {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_a_batch_reads_and_writes_only_its_periods(spark, seed):
    root = tempfile.mkdtemp(prefix="hearth-ledger-")
    ledger, fees = Ledger(spark, root), seed["fee_records"]
    fees = fees.unionByName(fees.withColumn("fee_id", F.col("fee_id") + 1000).withColumn("fee_period", F.lit("2026-04")))
    ledger.create(fees)
    assert rows(ledger.read()) == rows(fees.select(*ledger.read().columns))
    before = files(root + "/data")
    june = spark.createDataFrame([(8, "2026-06", 1, D("100.00")), (8, "2026-05", 2, D("1.00")), (404, "2026-06", 1, D("5.00")),
                                  (9, None, 1, D("5.00"))], PERIOD_PAYMENT_SCHEMA)
    assert {r.fee_period for r in fees.where("fee_id = 8").collect()} == {"2026-06"}
    outcomes, bills = post_by_period(ledger, june, 0, "2026-07-01")
    assert {(r.fee_id, r.seq): r.reason for r in outcomes.collect()} == {
        (8, 1): "OK", (8, 2): "UNKNOWN_FEE", (404, 1): "UNKNOWN_FEE", (9, 1): "UNKNOWN_FEE"}
    assert {os.path.basename(os.path.dirname(os.path.dirname(f))) for f in ledger.read(["2026-06"]).inputFiles()} >= {"fee_period=2026-06"}
    plan = ledger.read(["2026-06"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2026-06" in plan and "2026-05" not in plan
    ledger.write(bills, 0)
    new = files(root + "/data") - before
    assert before <= files(root + "/data") and new and all("fee_period=2026-06" in f or "fee_period=2026-05" in f for f in new)
    assert ledger.versions() == {"2026-04": -1, "2026-05": 0, "2026-06": 0}
    assert ledger.read().where("fee_id = 8").first().paid_amount == D("100.00")
    assert ledger.read().count() == fees.count()


def test_a_batch_tried_again_gives_the_same_ledger(spark, seed):
    ledger = Ledger(spark, tempfile.mkdtemp(prefix="hearth-ledger-"))
    ledger.create(seed["fee_records"])
    pay = spark.createDataFrame([(8, "2026-06", 1, D("100.00"))], PERIOD_PAYMENT_SCHEMA)
    for _ in range(3):                                              # epoch 0 fails after its write, twice
        _, bills = post_by_period(ledger, pay, 0)
        ledger.write(bills, 0)
    assert ledger.read().where("fee_id = 8").first().paid_amount == D("100.00")
    _, bills = post_by_period(ledger, pay, 1)
    ledger.write(bills, 1)
    assert ledger.read().where("fee_id = 8").first().paid_amount == D("200.00")
    want = rows(ledger.read())
    gone = ledger.vacuum(keep_from=2)
    assert len(gone) == 2 and all("fee_period=2026-06" in g for g in gone) and rows(ledger.read()) == want
    assert ledger.vacuum(keep_from=2) is not None and rows(ledger.read(["2026-05"])) == rows(seed["fee_records"].where("fee_period = '2026-05'").select(*ledger.read().columns))


def test_the_stream_by_period_equals_two_batches(spark, seed):
    root = tempfile.mkdtemp(prefix="hearth-stream-")
    src, out, ck = (os.path.join(root, x) for x in ("src", "out", "ck"))
    ledger = Ledger(spark, os.path.join(root, "ledger"))
    ledger.create(seed["fee_records"])
    period = {r.fee_id: r.fee_period for r in seed["fee_records"].collect()}
    batches = [[(8, 1, D("100.00")), (8, 2, D("200.00")), (9, 1, D("300.00"))], [(8, 3, D("149.50")), (8, 4, D("1.00"))]]
    for k, b in enumerate(batches):
        spark.createDataFrame([(f, period[f], s, x) for f, s, x in b], PERIOD_PAYMENT_SCHEMA).coalesce(1).write.parquet(f"{src}/b{k}")
        apply_payment_stream_by_period(read_payment_stream(spark, f"{src}/*", 1, PERIOD_PAYMENT_SCHEMA), ledger, out, ck,
                                       "2026-07-01").awaitTermination()
    ddl = "fee_id bigint, seq int, pay_amount decimal(10,2)"
    want = seed["fee_records"]
    for b in batches:
        want = B.settle(want, spark.createDataFrame(b, ddl), "2026-07-01")
    assert rows(ledger.read()) == rows(want.select(*ledger.read().columns))


@pytest.mark.parametrize("seed_", range(2))
def test_rules_after_batches_equal_the_full_rules(spark, seed, seed_):
    rng = random.Random(seed_)
    t = dict(seed)
    old = t["residents"].collect()
    ddl = ", ".join(f"{c.name} {c.dtype}" for c in S.TABLES["residents"].columns)
    for _ in range(2):
        now = t["residents"].collect()
        ins = [(rng.choice([None, 1, 2, 700, 701]), *x[1:5], rng.choice([x.id_card, x.id_card + " ", "AbC", "abc", "ÀBC", None]), *x[6:])
               for x in rng.choices(old, k=6)]
        dele = rng.sample(now, 2)
        new, gone = spark.createDataFrame(ins, ddl), spark.createDataFrame(dele, ddl)
        kept = list(now)
        for x in dele:
            kept.remove(x)
        after = dict(t) | {"residents": spark.createDataFrame([tuple(x) for x in kept] + ins, ddl)}
        for name, full in (("pk", I.pk_duplicates), ("unique", I.unique_violations)):
            counts = V.state(name, t)
            assert rows(V.violations(counts)) == rows(full(t))
            got = V.violations_after(counts, V.violations(counts), {"residents": (new, gone)})
            if name == "pk":
                assert rows(got) == rows(full(after))
            else:
                # after deletes a text group keeps its smallest spelling so far
                norm = lambda df: sorted((r.table_name, r.constraint_name, r.key_text.strip().lower().replace("à", "a"), r.n) for r in df.collect())
                assert norm(got) == norm(full(after))
        t = after


def test_counts_carry_on_from_batch_to_batch(spark, seed):
    rule = V.rules("bills")[0]
    bills = seed["fee_records"]
    twice = bills.where("fee_id < 6")
    touched, counts = V.added(rule, V.group_counts(rule, bills), twice)
    assert touched.where("old = 1 and n = 2").count() == 5 and counts.where("n = 2").count() == 5
    touched, counts = V.added(rule, counts, None, twice)
    assert counts.where("n > 1").count() == 0 and touched.count() == 5
    untouched = V.violations_after({rule: counts}, I.duplicate_bills(seed), {})
    assert untouched.count() == 0


def test_the_batch_alone_is_read_for_a_rule(spark, seed):
    """Given counts and the earlier listing, the rule's table is not scanned."""
    root = tempfile.mkdtemp(prefix="hearth-rules-")
    counts = {}
    for r, c in V.state("bills", seed).items():
        c.write.parquet(f"{root}/counts")
        counts[r] = spark.read.parquet(f"{root}/counts")
    I.duplicate_bills(seed).write.parquet(f"{root}/before")
    seed["fee_records"].limit(3).write.parquet(f"{root}/batch")
    got = V.violations_after(counts, spark.read.parquet(f"{root}/before"), {"fee_records": (spark.read.parquet(f"{root}/batch"), None)})
    assert {f.split(root)[1].split("/")[1] for f in got.inputFiles()} == {"counts", "before", "batch"}
    assert got.count() == 3


def test_small_reports(spark, seed):
    got = [json.loads(r.json) for r in R.staff_json(seed).collect()]
    assert got[0]["hire_date"].count("-") == 2 and any("一" <= c <= "鿿" for c in got[0]["name"])
    assert R.any_row(seed["fee_records"].where("fee_id > 999999"), "fee_id").count() == 0
    assert R.sample_unpaid_bill(seed).first().fee_id == seed["fee_records"].where("status = '待缴'").agg(F.min("fee_id")).first()[0]
    assert R.foreign_key_usage(seed).count() == 11
    t = spark.createDataFrame([(1, datetime(2026, 7, 1, 9, 5, 0), None, ""), (2, None, datetime(2026, 12, 31, 23, 0, 9), "x")],
                              "visitor_id bigint, entry_time timestamp_ntz, exit_time timestamp_ntz, remark string")
    assert [tuple(r) for r in R.visitor_times({"visitor_records": t}).orderBy("visitor_id").collect()] == [
        (1, "2026/7/1 09:05:00", "未离开", "2026/7/1", "-"), (2, None, "2026/12/31 23:00:09", None, "x")]
