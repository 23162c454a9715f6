"""Goldens worked out by hand from the reference's seed data, including row order."""

from datetime import date, datetime
from decimal import Decimal as D

from pyspark.sql import functions as F

from hearth.operators import billing as B
from hearth.operators import changes as M
from hearth.operators import reports as R


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_community_summary(seed):
    r = rows(R.community_summary(seed))[0]
    assert r == {"buildings": 4, "units": 8, "rooms": 17, "residents": 15, "parking_spaces": 14,
                 "vehicles": 7, "staff": 7}


def test_dashboard(seed):
    r = rows(R.dashboard(seed))[0]
    assert (r["buildings"], r["rooms_total"], r["rooms_occupied"], r["residents"]) == (4, 17, 14, 15)
    assert (r["parking_total"], r["parking_available"]) == (14, 6)
    assert (r["repairs_total"], r["repairs_pending"]) == (8, 7)
    assert (r["complaints_total"], r["complaints_pending"]) == (6, 1)
    assert (r["fees_total"], r["fees_unpaid"]) == (31, 25)


def test_building_rollup(seed):
    got = [(r["building_name"], r["unit_count"], r["room_count"]) for r in rows(R.building_rollup(seed))]
    assert got == [("A栋", 2, 8), ("B栋", 2, 3), ("C栋", 2, 3), ("D栋", 2, 3)]


def test_parking(seed):
    o = rows(R.parking_overview(seed))[0]
    assert (o["total_spaces"], o["available"], o["rented"], o["sold"], o["under_maintenance"]) == (14, 6, 6, 1, 1)
    assert o["occupancy_rate"] == "50.0%"
    by = {r["area_name"]: (r["total"], r["available"]) for r in rows(R.parking_by_area(seed))}
    assert by == {"地下一层A区": (5, 2), "地下一层B区": (5, 2), "地下二层": (4, 2)}


def test_fee_report_june(seed):
    got = {r["category_name"]: (r["total_bills"], r["total_amount"], r["paid_count"], r["payment_rate"])
           for r in rows(R.fee_report(seed, "2026-06"))}
    assert got == {"物业管理费": (11, D("2784.75"), 0, "0.0%"), "停车管理费": (5, D("1800.00"), 1, "20.0%"),
                   "垃圾处理费": (8, D("120.00"), 0, "0.0%")}
    order = [r["category_name"] for r in rows(R.fee_report(seed, "2026-06"))]
    assert order == ["物业管理费", "停车管理费", "垃圾处理费"]      # total_amount descending


def test_fee_report_may(seed):
    got = {r["category_name"]: (r["total_bills"], r["total_amount"], r["paid_count"], r["overdue_count"],
                                r["payment_rate"]) for r in rows(R.fee_report(seed, "2026-05"))}
    assert got == {"物业管理费": (3, D("710.75"), 2, 1, "66.7%"), "垃圾处理费": (3, D("45.00"), 2, 1, "66.7%"),
                   "电梯维护费": (1, D("30.00"), 1, 0, "100.0%")}


def test_generate_bills(seed):
    july = rows(B.generate_bills(seed, "2026-07"))
    assert len(july) == 75
    assert sum(r["amount"] for r in july) == D("9341.70")
    assert {r["due_date"] for r in july} == {date(2026, 7, 25)}
    assert len(rows(B.generate_bills(seed, "2026-06"))) == 51
    assert rows(B.generate_bills(seed, "2026-13")) == []                # malformed period: nothing
    assert len(rows(B.generate_bills(seed, ["2026-07", "2026-06"]))) == 126
    assert len(rows(B.generate_bills(seed, ["2026-07", "2026-07"]))) == 75      # a repeated period counts once


def test_bill_amounts_trigger(spark, seed):
    nb = spark.createDataFrame([(1, 1, D("0"), "2026-07", date(2026, 7, 25)), (1, 2, D("0"), "2026-07", date(2026, 7, 25)),
                                (1, 1, D("99"), "2026-07", date(2026, 7, 25))],
                               "resident_id bigint, category_id bigint, amount decimal(10,2), fee_period string, due_date date")
    assert [r["amount"] for r in rows(B.bill_amounts(nb, seed))] == [D("223.75"), D("300.00"), D("99.00")]


def test_boards_order(seed):
    assert [r["order_id"] for r in rows(R.repair_board(seed))] == [6, 8, 4, 2, 3, 7, 1, 5]
    assert [r["complaint_id"] for r in rows(R.complaint_board(seed))] == [5, 3, 6, 1, 4, 2]
    assert [r["announcement_id"] for r in rows(R.announcement_board(seed))] == [3, 2, 5, 1, 4]
    assert [r["announcement_id"] for r in rows(R.latest_announcements(seed))] == [3, 2, 5, 1, 4]


def test_visitor_log(seed):
    v = rows(R.visitor_log(seed))
    assert len(v) == 7
    assert sorted(r["visitor_id"] for r in v if r["is_open"]) == [5, 7]


def test_resident_overview_one(seed):
    o = rows(R.resident_overview(seed, residents=[1]))[0]
    assert (o["vehicle_count"], o["repair_count"], o["complaint_count"]) == (1, 1, 1)
    assert o["full_address"] == "A栋 1单元 101"
    assert rows(R.resident_unpaid(seed, residents=[1])) == []
    assert [r["order_id"] for r in rows(R.resident_recent_repairs(seed, residents=[1]))] == [1]


def test_staff_list_enum_order(seed):
    assert [r["staff_id"] for r in rows(R.staff_list(seed))] == [1, 2, 3, 4, 5, 6, 7]


def test_room_occupancy_move_in(spark, seed):
    new = seed["residents"].filter("resident_id = 1").withColumn("resident_id", F.lit(100).cast("bigint")) \
        .withColumn("room_id", F.lit(4).cast("bigint"))
    rooms = {r["room_id"]: r["status"] for r in rows(M.room_occupancy(seed["rooms"], new))}
    assert rooms[4] == "已入住" and rooms[8] == "空置"


def test_repair_completion_stamps(spark, seed):
    ch = spark.createDataFrame([(2, "已完成"), (5, "已完成"), (1, "待处理")], "order_id bigint, status string")
    out = {r["order_id"]: r for r in rows(M.repair_completion(seed["repair_orders"], ch, "2026-07-01 08:00:00"))}
    assert out[2]["completed_at"] == datetime(2026, 7, 1, 8, 0)
    assert out[5]["completed_at"] is None          # already 已完成: no new stamp
    assert out[1]["status"] == "待处理" and out[1]["staff_id"] == 2   # absent column kept


def test_staff_resignation(spark, seed):
    ch = spark.createDataFrame([(2, "离职"), (7, "离职")], "staff_id bigint, status string")
    out = M.staff_resignation(seed["staff"], ch, seed["repair_orders"])
    orders = {r["order_id"]: (r["staff_id"], r["status"]) for r in rows(out["repair_orders"])}
    assert orders[1] == (None, "待处理") and orders[3] == (None, "待处理") and orders[7] == (None, "待处理")
    assert orders[5] == (3, "已完成")
    assert {r["staff_id"]: r["status"] for r in rows(out["staff"])}[2] == "离职"


def test_cascade_delete_building(seed):
    new = M.cascade_delete(seed, "buildings", [1])
    assert new["buildings"].count() == 3 and new["units"].count() == 6 and new["rooms"].count() == 9
    # building A holds residents 1,2,3,4,5,6,14,15 -> 7 residents remain
    assert new["residents"].count() == 7
    counts = {r["table_name"]: r["deleted_rows"] for r in rows(M.deleted_counts(seed, "buildings", [1]))}
    assert counts["rooms"] == 8 and counts["vehicles"] == 4


def test_set_null_on_delete(seed):
    v = {r["vehicle_id"]: r["space_id"] for r in rows(M.set_null_on_delete(seed["vehicles"], "space_id", [1, 2]))}
    assert v[1] is None and v[2] is None and v[3] == 4


def test_dense_ordinals(spark):
    from hearth.plans.ordinals import dense_ordinals
    got = dense_ordinals(spark.range(40).repartition(3).orderBy(F.col("id").desc()), "n").collect()
    assert {(r["id"], r["n"]) for r in got} == {(i, 40 - i) for i in range(40)}


def test_generated_bills_can_be_paid(spark, seed):
    bills = B.generate_bills(seed, "2026-07", "2026-07-01 00:00:00")
    assert bills.columns == seed["fee_records"].columns
    ledger = seed["fee_records"].unionByName(bills)
    assert ledger.select("fee_id").distinct().count() == ledger.count()
    pay = bills.filter("amount > 0").selectExpr("fee_id", "1 AS seq", "amount AS pay_amount")
    assert {r["reason"] for r in rows(B.post_payments(ledger, pay))} == {"OK"}
    assert B.settle(ledger, pay, "2026-07-02 00:00:00").join(pay, "fee_id").filter("status <> '已缴'").isEmpty()


def test_inserts_first_valid_row_wins(spark, seed):
    ddl = ("seq int, resident_id bigint, room_id bigint, name string, gender string, phone string, id_card string, "
           "relationship string, move_in_date date")
    row = lambda seq, key, card: (seq, key, 4, "甲", "女", "13800000100", card, "业主", date(2026, 7, 1))
    # key 200 twice (seq 2 loses), its card is then free for 201; 202 comes first by seq
    batch = spark.createDataFrame([row(1, 200, "A1"), row(2, 200, "A2"), row(3, 201, "A2"), row(5, 203, "A3"),
                                   row(4, 202, "A3")], ddl)
    out = M.validated_inserts(seed, batch, "residents", "2026-07-01 00:00:00")
    assert {(r["resident_id"], r["id_card"]) for r in rows(out["accepted"])} == {(200, "A1"), (201, "A2"), (202, "A3")}
    assert sorted((r["resident_id"], r["reasons"]) for r in rows(out["rejected"])) == [(200, ["PK"]), (203, ["UNIQUE:id_card"])]


def test_changes_without_a_usable_seq(spark, seed):
    ch = spark.createDataFrame([(1, "红"), (1, "白"), (2, "黑")], "vehicle_id bigint, color string")
    out = rows(M.apply_updates(seed["vehicles"], ch, "vehicles"))
    assert len(out) == 7 and {r["vehicle_id"]: r["color"] for r in out}[1] == max("红", "白")
    ch = spark.createDataFrame([(1, None, "红"), (1, 1, "白"), (2, None, "黑")], "vehicle_id bigint, seq int, color string")
    out = {r["vehicle_id"]: r["color"] for r in rows(M.apply_updates(seed["vehicles"], ch, "vehicles"))}
    assert out[1] == "白" and out[2] == "黑"


def test_resignation_counts_every_step(spark, seed):
    s = seed["repair_orders"].filter("staff_id IS NOT NULL AND status IN ('待处理', '处理中')").first()["staff_id"]
    gone = seed["staff"].withColumn("status", F.when(F.col("staff_id") == s, "离职").otherwise(F.col("status")))
    ch = spark.createDataFrame([(s, 1, "在职"), (s, 2, "离职")], "staff_id bigint, seq int, status string")
    assert [r["resigned_id"] for r in rows(M.resigned_staff(gone, ch))] == [s]
    assert rows(M.resigned_staff(gone, ch.filter("seq = 2"))) == []


def test_apply_inserts_defaults(spark, seed):
    batch = spark.createDataFrame([(100, 4, "新住户", "女", "13800000100", "110101200001010000", None, date(2026, 7, 1))],
                                  "resident_id bigint, room_id bigint, name string, gender string, phone string, "
                                  "id_card string, relationship string, move_in_date date")
    out = M.apply_inserts(seed["residents"], batch, "residents", "2026-07-01 09:00:00")
    new = [r for r in rows(out) if r["resident_id"] == 100][0]
    assert out.count() == 16 and new["relationship"] == "业主" and new["created_at"] == datetime(2026, 7, 1, 9, 0)


def test_apply_updates_semantics(spark, seed):
    ch = spark.createDataFrame([(1, None), (999, "黑色")], "vehicle_id bigint, color string")
    out = {r["vehicle_id"]: r for r in rows(M.apply_updates(seed["vehicles"], ch, "vehicles"))}
    assert len(out) == 7                                  # unknown key 999: nothing added
    assert out[1]["color"] is None and out[1]["space_id"] == 1   # present-but-null wins, absent kept


def test_visit_exit_and_assignment(spark, seed):
    v = {r["visitor_id"]: r["exit_time"] for r in rows(M.visit_exit(seed["visitor_records"], [1, 5], "2026-07-01 00:00:00"))}
    assert v[1] == datetime(2026, 7, 1) and v[5] == datetime(2026, 7, 1) and v[7] is None
    a = spark.createDataFrame([(2, 3), (1, None)], "order_id bigint, staff_id bigint")
    o = {r["order_id"]: (r["staff_id"], r["status"]) for r in rows(M.repair_assignment(seed["repair_orders"], a))}
    assert o[2] == (3, "处理中") and o[1] == (None, "待处理") and o[3] == (2, "处理中")


def test_payment_status_rule(spark):
    df = spark.createDataFrame([(1, D("10.00"), D("10.00"), "待缴", None), (2, D("10.00"), D("4.00"), "逾期", None),
                                (3, D("0.00"), D("0.00"), "待缴", None)],
                               "fee_id bigint, amount decimal(10,2), paid_amount decimal(10,2), status string, paid_date date")
    got = {r["fee_id"]: (r["status"], r["paid_date"]) for r in rows(B.payment_status(df, "2026-07-02 00:00:00"))}
    assert got == {1: ("已缴", date(2026, 7, 2)), 2: ("部分缴纳", None), 3: ("待缴", None)}


def test_integrity_on_seed(spark, seed):
    from hearth.operators import integrity as I
    assert I.pk_duplicates(seed).count() == 0 and I.fk_orphans(seed).count() == 0
    assert I.enum_violations(seed).count() == 0 and I.check_violations(seed).count() == 0
    dup = seed["buildings"].unionByName(seed["buildings"].filter("building_id = 1")
                                        .selectExpr("5 AS building_id", "'a栋 ' AS building_name", "total_floors",
                                                    "address", "created_at"))
    t2 = dict(seed)
    t2["buildings"] = dup
    u = rows(I.unique_violations(t2))
    assert u == [{"table_name": "buildings", "constraint_name": "building_name", "key_text": "A栋", "n": 2}]


def test_empty_tables(spark, seed):
    empty = {n: df.limit(0) for n, df in seed.items()}
    d = rows(R.dashboard(empty))[0]
    assert d["buildings"] == 0 and d["rooms_total"] == 0 and d["rooms_occupied"] is None   # SUM(CASE) over nothing
    o = rows(R.parking_overview(empty))[0]
    assert o["total_spaces"] == 0 and o["available"] is None and o["occupancy_rate"] is None
    assert R.fee_report(empty).count() == 0 and B.generate_bills(empty, "2026-07").count() == 0
    assert {r["row_count"] for r in rows(R.table_counts(empty))} == {0} and R.table_counts(empty).count() == 13


def test_unknown_status_sorts_first_and_null_refs(spark, seed):
    odd = seed["repair_orders"].withColumn(
        "status", F.when(F.col("order_id") == 5, F.lit("搁置")).otherwise(F.col("status")))
    t = dict(seed)
    t["repair_orders"] = odd
    board = rows(R.repair_board(t))
    assert board[0]["order_id"] == 5 and board[0]["status_rank"] == 0
    from hearth.operators import integrity as I
    # vehicle 6 has no space (NULL): not an orphan; a dangling space is
    t["vehicles"] = seed["vehicles"].withColumn(
        "space_id", F.when(F.col("vehicle_id") == 7, F.lit(777).cast("bigint")).otherwise(F.col("space_id")))
    orphans = rows(I.fk_orphans(t))
    assert orphans == [{"table_name": "vehicles", "column_name": "space_id", "row_key": 7, "ref_value": 777}]


def test_sequenced_changes(spark, seed):
    ch = spark.createDataFrame([(2, 1, "已完成"), (2, 2, "处理中"), (4, 1, "处理中"), (4, 2, "处理中")],
                               "order_id bigint, seq int, status string")
    out = {r["order_id"]: r for r in rows(M.repair_completion(seed["repair_orders"], ch, "2026-07-01 00:00:00"))}
    assert len(out) == 8
    assert out[2]["status"] == "处理中" and out[2]["completed_at"] == datetime(2026, 7, 1)   # entered then left
    assert out[4]["status"] == "处理中" and out[4]["completed_at"] is None


def test_validated_inserts(spark, seed):
    ddl = ("resident_id bigint, room_id bigint, name string, gender string, phone string, id_card string, "
           "relationship string, move_in_date date")
    batch = spark.createDataFrame([
        (100, 4, "甲", "女", "13800000100", "110101200001010001", None, date(2026, 7, 1)),     # fine
        (101, 99, "乙", "男", "13800000101", "110101200001010002", "业主", date(2026, 7, 1)),  # no room 99
        (1, 4, "丙", "男", "13800000102", "110101200001010003", "业主", date(2026, 7, 1)),     # key taken
        (102, 4, "丁", "X", "13800000103", "110101199001011234", "业主", None),                # enum, unique, null
        (103, 4, "戊", "男", "13800000104", "110101200001010005", "朋友", date(2026, 7, 1)),   # enum
        (104, 4, "己", "男", "13800000105", "110101200001010005", "业主", date(2026, 7, 1)),   # same id_card twice
    ], ddl)
    out = M.validated_inserts(seed, batch, "residents", "2026-07-01 00:00:00")
    rej = {r["resident_id"]: sorted(r["reasons"]) for r in rows(out["rejected"])}
    assert sorted(r["resident_id"] for r in rows(out["accepted"])) == [100, 104]
    assert rej[101] == ["FK:room_id"] and rej[1] == ["PK"]
    assert rej[102] == ["ENUM:gender", "NULL:move_in_date", "UNIQUE:id_card"]
    assert rej[103] == ["ENUM:relationship"] and 104 not in rej      # a refused row blocks nobody
    assert out["table"].count() == 17


def test_insert_defaults_other_table(spark, seed):
    batch = spark.createDataFrame([(9, 3, "漏水")], "order_id bigint, resident_id bigint, title string")
    out = {r["order_id"]: r for r in rows(M.apply_inserts(seed["repair_orders"], batch, "repair_orders",
                                                          "2026-07-01 10:00:00"))}
    new = out[9]
    assert (new["priority"], new["status"], new["staff_id"], new["completed_at"]) == ("中", "待处理", None, None)
    assert new["created_at"] == datetime(2026, 7, 1, 10, 0)


def test_parking_list(seed):
    got = rows(R.parking_list(seed))
    assert len(got) == 14 and [r["space_id"] for r in got] == list(range(1, 15))
    by = {r["space_id"]: (r["plate_no"], r["resident_name"]) for r in got}
    assert by[1] == ("京A12345", "张伟") and by[3] == (None, None) and by[12] == ("京G55555", "马超")


def test_validated_inserts_null_keys_do_not_collide(spark, seed):
    ddl = "vehicle_id bigint, resident_id bigint, space_id bigint, plate_no string, vehicle_type string"
    batch = spark.createDataFrame([(20, 1, None, None, "轿车"), (21, 2, None, None, "轿车")], ddl)
    rej = {r["vehicle_id"]: sorted(r["reasons"]) for r in rows(M.validated_inserts(seed, batch, "vehicles")["rejected"])}
    assert rej == {20: ["NULL:plate_no"], 21: ["NULL:plate_no"]}
