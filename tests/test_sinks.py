import json
import os
import tempfile
from datetime import date
from decimal import Decimal as D

from hearth.operators import reports as R
from hearth.sources.parquet import read_estate, to_json_lines, write_estate


def test_json_lines_exact(spark):
    df = spark.createDataFrame([(1, D("1.50"), date(2026, 6, 25), None, "A栋")],
                               "id bigint, amount decimal(10,2), due date, note string, name string")
    line = to_json_lines(df).collect()[0]["json"]
    assert '"amount":1.50' in line and '"due":"2026-06-25"' in line and '"note":null' in line
    assert json.loads(line)["name"] == "A栋"


def test_estate_round_trip(spark, seed):
    root = tempfile.mkdtemp(prefix="hearth-estate-")
    write_estate(seed, root)
    assert os.path.isdir(os.path.join(root, "fee_records", "fee_period=2026-06"))
    back = read_estate(spark, root)
    assert back["fee_records"].count() == 31
    assert back["fee_records"].filter("fee_period = '2026-05'").count() == 7
    assert [r["building_name"] for r in R.building_rollup(back).collect()] == ["A栋", "B栋", "C栋", "D栋"]


def test_multi_result_sets(seed, spark):
    sets = R.resident_overview_sets(seed, residents=[1])
    assert set(sets) == {"info", "unpaid_fees", "recent_repairs"}
    assert sets["unpaid_fees"].count() == 0 and sets["recent_repairs"].count() == 1
    assert R.foreign_keys(spark).count() == 11


def test_append_rows_partitioned(spark, seed):
    from hearth.sources.parquet import append_rows
    root = tempfile.mkdtemp(prefix="hearth-append-")
    write_estate({"fee_records": seed["fee_records"]}, root)
    append_rows(seed["fee_records"].filter("fee_period = '2026-05'"), os.path.join(root, "fee_records"),
                "fee_records")
    back = read_estate(spark, root, ["fee_records"])["fee_records"]
    assert back.count() == 38 and back.filter("fee_period = '2026-05'").count() == 14
