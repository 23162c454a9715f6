"""Plan properties the jobs are designed for (checked on the physical plans, small data)."""

import os
import tempfile

import pytest

from hearth import registry
from hearth.operators import reports as R
from hearth.sources.parquet import load_estate, read_estate, write_estate

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="provided tables not present")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def estate(spark):
    root = tempfile.mkdtemp(prefix="hearth-plans-")
    write_estate(load_estate(spark, SF), root)
    return read_estate(spark, root)


@pytest.mark.parametrize("key", sorted(registry.jobs()))
def test_no_product_joins(estate, key):
    if key in ("bill_amounts", "generate_bills"):
        return                                    # every resident x category pair is their result
    p = plan(registry.jobs()[key](estate))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_top_n_limited_before_shuffle(estate):
    p = plan(R.resident_recent_repairs(estate))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_filter_reaches_scan(estate):
    p = plan(R.vacant_rooms(estate))
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,空置)" in p


def test_period_prunes_partitions(estate):
    p = plan(R.fee_report(estate, "1998-03"))
    assert "PartitionFilters: [isnotnull(fee_period" in p and "(fee_period#" in p


def test_scan_reads_only_needed_columns(estate):
    p = plan(R.fee_report(estate))
    schema = [line for line in p.split("\n") if "fee_records" in line and "ReadSchema" in line][0]
    assert "created_at" not in schema and "due_date" not in schema


def test_snapshot_read_once(estate):
    for key, table in (("repair_completion", "repair_orders"), ("complaint_resolution", "complaints")):
        batch = estate[table].sparkSession.range(5).selectExpr(f"id AS {registry.S.TABLES[table].key}", "'已完成' AS status")
        stamp = {"repair_completion": registry.M.repair_completion, "complaint_resolution": registry.M.complaint_resolution}[key]
        assert plan(stamp(estate[table], batch)).count("FileScan") == 1


def test_one_child_scan_per_reference(estate):
    refs = sum(len(s.refs) for s in registry.S.TABLES.values())
    assert plan(registry.I.fk_orphans(estate)).count("FileScan") == 2 * refs


def test_fold_keeps_its_own_exchange(spark, estate):
    """Even when the join below is a sort-merge join on fee_id, the fold's exchange survives."""
    from hearth.operators import billing as B
    from hearth.sources import batches as X
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        df = B.post_payments(estate["fee_records"], X.payments(estate))
        df.write.format("noop").mode("overwrite").save()
        p = plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in p and "REPARTITION_BY_COL" in p and "__fold_part" in p
