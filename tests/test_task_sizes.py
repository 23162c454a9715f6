"""A task's share does not grow with the tables: shuffles are dealt to as many tasks as the rows ask for."""

from collections import Counter, defaultdict
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hearth import registry
from hearth import schemas as S
from hearth.operators import integrity as I
from hearth.operators import integrity_delta as V
from hearth.sources import derived
from hearth.sources.derived import BASE_SCHEMAS, LazyTables
from hearth.sources.dirty import dirty_estate


def lines(spark):
    """Orders 1 to 100 of six lines, the sixth with the number of the fifth; order 7 twice; lines of no order and of none known."""
    at = datetime(1998, 3, 4)
    li = [(o, 10 * o + k, 1, min(k, 5), 1.0, float(k), 0.0, 0.0, "N", "F", at) for o in range(1, 101) for k in range(1, 7)]
    li += [(None, 1, 1, 1, 1.0, 9.0, 0.0, 0.0, "R", "O", at), (999, 1, 1, 1, 1.0, 9.0, 0.0, 0.0, "R", "O", at)]
    od = [(o, o % 9, "O", 1.0, at, "2-HIGH") for o in [*range(1, 101), 7]] + [(None, 3, "O", 1.0, at, "2-HIGH")]
    return spark.createDataFrame(li, BASE_SCHEMAS["lineitem"]), spark.createDataFrame(od, BASE_SCHEMAS["orders"])


def test_bills_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(derived, "ROWS_A_TASK", 50)
    got = derived.fee_records(*lines(spark)).withColumn("task", F.spark_partition_id()).collect()
    want = defaultdict(Decimal)
    for o in range(1, 101):
        for k in range(1, 7):
            want[10 * o + min(k, 5)] += k * (2 if o == 7 else 1)
    assert {r.fee_id: r.amount for r in got} == want and len(got) == len(want) == 500
    assert max(Counter(r.task for r in got).values()) <= 125          # in one task before, as AQE joined its partitions


def test_a_scan_deals_lines_to_no_more_tasks_than_it_writes_unheld(spark):
    od = lines(spark)[1]
    n = F.col("id")
    values = [n % 2**25, n, n, (n % 4).cast("int"), *[F.lit(1.0)] * 4, F.lit("N"), F.lit("F"), F.lit("1998-03-04").cast("timestamp_ntz")]
    names = [c.split()[0] for c in BASE_SCHEMAS["lineitem"].split(", ")]
    for rows, tasks in ((30_000_000, 150), (216_000_000, 200), (240_000_000, 200), (480_000_000, 400)):      # 1,080 of 216,000,000 before
        li = spark.range(rows).select(*[v.alias(c) for c, v in zip(names, values, strict=True)])
        plan = derived.fee_records(li, od)._jdf.queryExecution().executedPlan().toString()
        assert f", {tasks}), REPARTITION_BY_NUM" in plan


def estate(spark, rows):
    def table(n):
        spec = S.TABLES[n]
        keys = spark.range(1, 9) if n != "fee_records" else spark.range(30_000).select(
            F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id")).alias("id"))
        return derived.conform(keys.withColumnRenamed("id", spec.key), n)
    return LazyTables({n: lambda n=n: table(n) for n in S.TABLES}, rows)


def test_keys_of_all_tables_are_counted_in_one_grouping(spark, monkeypatch):
    monkeypatch.setattr(I, "KEYS_A_TASK", 1000)
    nulls = sum(i % 3 != 0 for i in range(1, 30_000, 1000))
    want = {("fee_records", 5): 10_001, ("fee_records", None): nulls}
    for rows, tasks in ((lambda: 30_000, 30), (lambda: None, 8)):
        found = I.pk_duplicates(estate(spark, rows))
        assert {(r.table_name, r.key_value): r.n for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count(f", {tasks}), REPARTITION") >= 1 and "ENSURE_REQUIREMENTS" not in plan


def test_a_dirty_estate_has_twice_the_rows(spark):
    assert dirty_estate(estate(spark, lambda: 40)).rows() == 80
    assert dirty_estate(dict(estate(spark, lambda: 40))).rows() is None


def test_a_key_of_very_many_rows_is_counted_before_the_shuffle(spark):
    t = estate(spark, lambda: None)
    t._built["fee_records"] = derived.conform(spark.range(0, 200_000, 1, 2).select(F.lit(5).alias("fee_id")), "fee_records")
    found = I.pk_duplicates(t)
    assert [(r.key_value, r.n) for r in found.collect()] == [(5, 200_000)]
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_key_counts_of_a_large_table_are_dealt_by_its_rows(spark, monkeypatch):
    monkeypatch.setattr(I, "KEYS_A_TASK", 1000)
    t = estate(spark, lambda: None)
    t.rows_of = lambda name: 30_000 if name == "fee_records" else 8
    counts = V.state("pk", t)
    bills = next(c for r, c in counts.items() if r.table == "fee_records")
    share = bills.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(share) > 8 and max(r["count"] for r in share) < 1500         # 19,971 groups; in one task before, as AQE joined its partitions
    nulls = sum(i % 3 != 0 for i in range(1, 30_000, 1000))
    found = V.violations_after(counts, V.violations(counts), {"residents": (t["residents"].where("resident_id = 3"), None)})
    assert {(r.table_name, r.key_value): r.n for r in found.collect()} == {
        ("fee_records", 5): 10_001, ("fee_records", None): nulls, ("residents", 3): 2}


def test_an_estate_knows_its_tables_sizes(spark):
    li, od = lines(spark)
    t = derived.derive_estate(spark, {"lineitem": li, "orders": od})
    assert (t.rows_of("fee_records"), t.rows_of("repair_orders"), t.rows_of("fee_categories")) == (602, 102, None)


OF_BILLS = ["ledger_after_payments", "duplicate_bills", "post_payments", "fee_periods", "foreign_key_usage"]


@pytest.mark.parametrize("name", OF_BILLS)
def test_a_query_of_bills_deals_them_by_their_number(spark, monkeypatch, name):
    li, od = lines(spark)
    parts = spark.createDataFrame([(k, "p", "b", "SMALL", 1, 800.0 + k) for k in range(6)], BASE_SCHEMAS["part"])
    base = {n: spark.createDataFrame([], d) for n, d in BASE_SCHEMAS.items()} | {"lineitem": li, "orders": od, "part": parts}
    found = []
    for share, tasks in ((50, 13), (30, 21)):        # more than the session's shuffle partitions
        monkeypatch.setattr(derived, "ROWS_A_TASK", share)
        df = registry.jobs()[name](derived.derive_estate(spark, base))
        assert f", {tasks}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()      # no such dealing before
        found.append(sorted(map(str, df.collect())))
    assert found[0] == found[1] and found[0]
