"""The payment fold against a plain sequential model, including long bills and split batches."""

import random
from decimal import Decimal as D

import pytest

from hearth import schemas as S
from hearth.operators import billing as B

FEES_DDL = "fee_id bigint, amount decimal(10,2), paid_amount decimal(10,2), status string"
PAY_DDL = "fee_id bigint, seq int, pay_amount decimal(10,2)"


def model(fees, pays):
    """Straight transcription of the rules, one payment at a time."""
    state = {f: [a, p, s] for f, a, p, s in fees}
    out = {}
    for f, seq, x in sorted(pays, key=lambda r: (r[0], r[1])):
        if f not in state:
            out[(f, seq)] = ("UNKNOWN_FEE", None, None)
            continue
        a, p, s = state[f]
        if s == "已缴":
            r = "ALREADY_PAID"
        elif x is None or x <= 0:
            r = "NON_POSITIVE"
        elif p + x > a:
            r = "OVERPAY"
        else:
            r = "OK"
            p = p + x
            if p >= a and p > 0:
                s = "已缴"
            elif 0 < p < a:
                s = "部分缴纳"
            state[f] = [a, p, s]
        out[(f, seq)] = (r, p, s)
    return out


def run(spark, fees, pays):
    f = spark.createDataFrame(fees, FEES_DDL)
    p = spark.createDataFrame(pays, PAY_DDL)
    return {(r["fee_id"], r["seq"]): (r["reason"], r["paid_after"], r["status_after"])
            for r in B.post_payments(f, p).collect()}


def test_worked_example(spark):
    fees = [(8, D("249.50"), D("0"), "待缴"), (9, D("100.00"), D("100.00"), "已缴")]
    pays = [(8, 1, D("0")), (8, 2, D("100")), (8, 3, D("200")), (8, 4, D("149.50")), (8, 5, D("1")),
            (9, 1, D("5")), (404, 1, D("5"))]
    got = run(spark, fees, pays)
    assert got[(8, 1)] == ("NON_POSITIVE", D("0.00"), "待缴")
    assert got[(8, 2)] == ("OK", D("100.00"), "部分缴纳")
    assert got[(8, 3)] == ("OVERPAY", D("100.00"), "部分缴纳")
    assert got[(8, 4)] == ("OK", D("249.50"), "已缴")
    assert got[(8, 5)] == ("ALREADY_PAID", D("249.50"), "已缴")
    assert got[(9, 1)][0] == "ALREADY_PAID"
    assert got[(404, 1)] == ("UNKNOWN_FEE", None, None)


@pytest.mark.parametrize("batch", [10000, 7])
def test_random_against_model(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rnd = random.Random(batch)
    fees, pays = [], []
    for f in range(1, 200):
        amount = D(rnd.randint(0, 50000)) / 100
        status = rnd.choice(["待缴", "逾期", "部分缴纳", "已缴", "搁置"])   # last one: outside the domain
        fees.append((f, amount, D("0"), status))
        n = 300 if f % 50 == 0 else rnd.randint(1, 8)      # a few long bills pass the lock-step window
        for s in range(1, n + 1):
            x = rnd.choice([None, D("0"), D("-1.00"), D(rnd.randint(1, 30000)) / 100, D("0.01")])
            pays.append((f, s, x))
    pays += [(9999, 1, D("1")), (9999, 2, D("2"))]
    try:
        assert run(spark, fees, pays) == model(fees, pays)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_hot_bill(spark):
    """A single bill holding most payments is folded exactly, in one ordered stream."""
    fees = [(1, D("1000.00"), D("0"), "待缴")] + [(f, D("10.00"), D("0"), "待缴") for f in range(2, 50)]
    pays = [(1, s, D("0.37") if s % 3 else D("-1")) for s in range(1, 5000)]
    pays += [(f, 1, D("10.00")) for f in range(2, 50)]
    assert run(spark, fees, pays) == model(fees, pays)


@pytest.mark.parametrize("batch", [10000, 5])
def test_settle_finals_against_model(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rnd = random.Random(100 + batch)
    fees, pays = [], []
    for f in range(1, 120):
        fees.append((f, D(rnd.randint(1, 20000)) / 100, D("0"), rnd.choice(["待缴", "逾期", "已缴"])))
        for s in range(1, (200 if f % 40 == 0 else rnd.randint(0, 6)) + 1):
            pays.append((f, s, rnd.choice([D("0"), D(rnd.randint(1, 9000)) / 100])))
    try:
        out = B.settle(spark.createDataFrame([(f, a, p, s, None) for f, a, p, s in fees],
                                             FEES_DDL + ", paid_date date"),
                       spark.createDataFrame(pays, PAY_DDL), "2026-07-01 00:00:00")
        got = {r["fee_id"]: (r["paid_amount"], r["status"], r["paid_date"] is not None) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    steps = model(fees, pays)
    for f, a, p, s in fees:
        mine = [v for (ff, _), v in sorted(steps.items()) if ff == f]
        paid, st = (mine[-1][1], mine[-1][2]) if mine else (p, s)
        fired = any(r == "OK" and x == "已缴" for r, _, x in mine)
        assert got[f] == (paid, st, fired), f


def test_fold_exact_when_aqe_splits_the_join(spark):
    """Scattered payments, sort-merge join, skew splitting forced on: bills still fold in order."""
    rnd = random.Random(7)
    fees = [(f, D(rnd.randint(100, 90000)) / 100, D("0"), "待缴") for f in range(1, 60)]
    pays = [(1 + (i % 7 if i % 2 else rnd.randint(0, 58)), i, D(rnd.randint(1, 9000)) / 100) for i in range(1, 3000)]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        f = spark.createDataFrame(fees, FEES_DDL)
        p = spark.createDataFrame(pays, PAY_DDL).repartition(37)
        got = {(r["fee_id"], r["seq"]): (r["reason"], r["paid_after"], r["status_after"])
               for r in B.post_payments(f, p).collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == model(fees, pays)


def test_unusable_payments_get_a_reason_and_harm_no_other_bill(spark):
    """NULL and unknown ids, NULL seq and amounts out of range beside ids above 2^53."""
    from decimal import Decimal
    ids = [9007199254740993 + 2 * k for k in range(6)]
    fees = spark.createDataFrame([(i, Decimal("60.00"), Decimal("0.00"), S.FEE_STATUS[0], None) for i in ids],
                                 "fee_id bigint, amount decimal(10,2), paid_amount decimal(10,2), status string, paid_date date")
    pay = spark.createDataFrame([(i, 1, Decimal("60.00")) for i in ids] + [
        (None, 1, Decimal("5.00")), (7, 1, Decimal("5.00")), (ids[0], None, Decimal("5.00")), (ids[1], 2, Decimal("123456789012.00"))],
        "fee_id bigint, seq int, pay_amount decimal(14,2)").coalesce(1)
    got = B.post_payments(fees, pay).collect()
    assert {(r.fee_id, r.reason) for r in got} == {(i, "OK") for i in ids} | {
        (None, "UNKNOWN_FEE"), (7, "UNKNOWN_FEE"), (ids[0], "BAD_SEQUENCE"), (ids[1], "BAD_AMOUNT")}
    assert {(r.fee_id, r.status) for r in B.settle(fees, pay).collect()} == {(i, S.FEE_PAID) for i in ids}


def test_many_accepted_payments_on_one_bill(spark):
    from decimal import Decimal
    from pyspark.sql import functions as F
    n = 100_000
    fees = spark.createDataFrame([(1, Decimal("1000.00"), Decimal("0.00"), S.FEE_STATUS[0], None)],
                                 "fee_id bigint, amount decimal(10,2), paid_amount decimal(10,2), status string, paid_date date")
    pay = spark.range(n + 5).select(F.lit(1).cast("bigint").alias("fee_id"), F.col("id").cast("int").alias("seq"),
                                    F.lit("0.01").cast("decimal(10,2)").alias("pay_amount"))
    got = {r.reason: r["count"] for r in B.post_payments(fees, pay).groupBy("reason").count().collect()}
    assert got == {"OK": n, "ALREADY_PAID": 5}


# ----------------------------------------------------------------------------- bills posted in chunks

def test_walk_and_summaries_equal_one_by_one():
    import numpy as np

    from hearth.operators.payment_chunks import after, summarise, walk
    rng = random.Random(11)
    for _ in range(400):
        x = np.array([rng.choice([0, -3, rng.randint(1, 9), rng.randint(1, 200), 1 << rng.randint(0, 9)]) for _ in range(rng.randint(0, 60))], np.int64)
        r = rng.choice([0, -5, rng.randint(1, 900), 1 << rng.randint(0, 10)])
        left, want = r, []
        for v in x.tolist():
            want.append(0 < v <= left)
            left -= v if want[-1] else 0
        assert walk(r, x).tolist() == want
        quick = after(r, *summarise(x))
        assert quick is None or quick == left
        if (x <= 0).all():
            assert quick == left


@pytest.mark.parametrize("seed_", range(2))
def test_hot_bills_in_chunks_equal_the_model(spark, monkeypatch, seed_):
    from hearth.operators import payment_chunks as C
    monkeypatch.setattr(C, "HOT_PAYMENTS", 100)
    monkeypatch.setattr(C, "CHUNK_ROWS", 60)
    rng = random.Random(seed_)
    fees = [(1, D("500.00"), D("0"), "待缴"), (2, D("80.00"), D("20.00"), "部分缴纳"), (3, D("9.00"), D("9.50"), "逾期"),
            (4, D("5.00"), D("0"), "已缴"), (5, D("99999999.99"), D("0"), "待缴"), (6, D("10.00"), D("0"), "待缴")]
    cents = lambda top: D(rng.randint(-50, top)) / 100                                    # noqa: E731
    pays = [(f, s, rng.choice([None, D("0"), cents(300), cents(30000)])) for f in (1, 2, 3, 4, 404) for s in range(1, 401)]
    pays += [(5, s, D("99999.99")) for s in range(1, 1500)] + [(6, s, D("4")) for s in range(1, 6)]
    rng.shuffle(pays)
    assert run(spark, fees, pays) == model(fees, pays)
    cols = "fee_id bigint, amount decimal(10,2), paid_amount decimal(10,2), status string, paid_date date"
    f = spark.createDataFrame([(*x, None) for x in fees], cols)
    led = {r.fee_id: (r.paid_amount, r.status, r.paid_date is not None) for r in
           B.settle(f, spark.createDataFrame(pays, PAY_DDL), "2026-07-01").collect()}
    steps = model(fees, pays)
    for fee, _, paid0, status0 in fees:
        mine = [v for k, v in sorted(steps.items()) if k[0] == fee]
        paid, status = (mine[-1][1], mine[-1][2]) if mine else (paid0, status0)
        assert led[fee] == (paid, status, status == "已缴" and status0 != "已缴"), fee


def test_rounds_grow_with_the_bits_of_the_amount(spark, monkeypatch):
    from hearth.operators import payment_chunks as C
    monkeypatch.setattr(C, "HOT_PAYMENTS", 100)
    monkeypatch.setattr(C, "CHUNK_ROWS", 250)
    fees = [(1, D("100000.00"), D("0"), "待缴")]
    pays = [(1, s, D("300.00") if s % 2 else D("99999.00")) for s in range(1, 5001)]
    f, p = spark.createDataFrame(fees, FEES_DDL), spark.createDataFrame(pays, PAY_DDL)
    cold, chunks = B._cold_and_chunks(f, p)
    assert cold.count() == 0 and chunks.rows.select("chunk").distinct().count() >= 15 and chunks.rounds <= 25
    assert run(spark, fees, pays) == model(fees, pays)
