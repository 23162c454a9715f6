"""DuckDB SQL twins of the registered queries (the correctness gate's oracle).

Each oracle starts from the provided base tables: the estate tables are
CTEs with the same formulas the Spark builders in
:mod:`hearth.sources.derived` use, conformed to the declared schema.  The
oracle bodies are written the way the reference states each query
(correlated counts, ``COUNT(DISTINCT)`` after fan-out, a recursive walk for
payments), so they check the Spark plans rather than repeat them.
"""

from __future__ import annotations

from .schemas import COMPLAINT_STATUS, REPAIR_STATUS, TABLES, duck_type

# FIXTURES.md §3, DuckDB spelling.
_DERIVED = {
    "buildings": """
SELECT CAST(r_regionkey AS BIGINT) building_id, r_name building_name, CASE WHEN r_regionkey % 2 = 0 THEN 18 ELSE 6 END total_floors, CASE WHEN r_regionkey = 0 THEN NULL ELSE 'Block ' || r_name END address FROM region
UNION ALL SELECT CAST(99 AS BIGINT), 'EMPTY', 12, NULL""",
    "units": """
SELECT CAST(n_nationkey AS BIGINT) unit_id, CAST(n_regionkey AS BIGINT) building_id, n_name unit_number, 12 floors FROM nation
UNION ALL SELECT CAST(999 AS BIGINT), CAST(0 AS BIGINT), 'NO ROOMS', 6""",
    "rooms": """
SELECT c_custkey room_id, CAST(c_nationkey AS BIGINT) unit_id, c_name room_number, CAST(40 + (c_custkey % 9000) * 0.01 AS DECIMAL(10,2)) area,
CASE c_mktsegment WHEN 'BUILDING' THEN '商铺' WHEN 'FURNITURE' THEN '储藏室' ELSE '住宅' END room_type,
CASE WHEN c_custkey % 7 = 6 THEN '空置' WHEN c_custkey % 11 = 10 THEN '装修中' ELSE '已入住' END status FROM customer""",
    "residents": """
SELECT c_custkey resident_id, CASE WHEN c_custkey % 7 = 6 THEN c_custkey - 1 ELSE c_custkey END room_id, c_name name,
CASE WHEN c_custkey % 2 = 0 THEN '男' ELSE '女' END gender, CAST(13800000000 + c_custkey AS VARCHAR) phone, CAST(110101190000000000 + c_custkey AS VARCHAR) id_card,
CASE WHEN c_custkey % 7 = 6 THEN '家属' WHEN c_custkey % 5 = 4 THEN '租客' ELSE '业主' END relationship,
CAST('2015-01-01' AS DATE) + CAST(c_custkey % 3000 AS INT) move_in_date FROM customer""",
    "parking_spaces": """
SELECT p_partkey space_id, p_brand || '-' || CAST(p_partkey AS VARCHAR) space_number, p_brand area_name,
CASE WHEN p_type IN ('LARGE','PROMO') THEN '大型' WHEN p_type = 'ECONOMY' THEN '充电' ELSE '普通' END space_type,
CASE WHEN p_size <= 20 THEN '空闲' WHEN p_size <= 40 THEN '已租' WHEN p_size <= 47 THEN '已售' ELSE '维修中' END status,
CAST(p_retailprice AS DECIMAL(10,2)) monthly_price FROM part""",
    "vehicles": """
SELECT c_custkey vehicle_id, c_custkey resident_id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey - c_custkey % 4 END space_id,
'P' || CAST(c_custkey AS VARCHAR) plate_no, CASE c_custkey % 8 WHEN 0 THEN '轿车' WHEN 2 THEN 'SUV' WHEN 4 THEN '电动车' ELSE '摩托车' END vehicle_type FROM customer""",
    "fee_categories": """
SELECT category_id, CASE category_id WHEN 1 THEN '物业管理费' WHEN 2 THEN '停车管理费' WHEN 3 THEN '垃圾处理费' WHEN 4 THEN '公共维修基金' WHEN 5 THEN '电梯维护费' WHEN 6 THEN '水费' END category_name,
CASE WHEN category_id = 6 THEN '季' ELSE '月' END billing_cycle, CASE WHEN category_id IN (1, 4) THEN '按面积' WHEN category_id = 6 THEN '按用量' ELSE '固定' END calc_method,
CAST(p * 0.0125 AS DECIMAL(10,4)) unit_price FROM (SELECT 1 + p_partkey % 6 category_id, min(CAST(p_retailprice AS DECIMAL(10,2))) p FROM part GROUP BY 1) g""",
    "fee_records": """
SELECT fee_id, resident_id, category_id, amount, CAST(CASE WHEN status = '已缴' THEN amount WHEN status = '部分缴纳' THEN amount * 0.5 ELSE 0 END AS DECIMAL(10,2)) paid_amount, fee_period, status, CAST(fee_period || '-25' AS DATE) due_date, CASE WHEN status = '已缴' THEN CAST(l_shipdate AS DATE) END paid_date, l_shipdate created_at FROM (
SELECT l_orderkey * 10 + l_linenumber fee_id, o_custkey resident_id, 1 + l_partkey % 6 category_id, CAST(l_extendedprice AS DECIMAL(10,2)) amount, substr(CAST(l_shipdate AS VARCHAR),1,7) fee_period,
CASE WHEN l_linestatus = 'F' AND l_returnflag IN ('N','A') THEN '已缴' WHEN l_linestatus = 'F' THEN '逾期' WHEN l_returnflag = 'R' THEN '部分缴纳' ELSE '待缴' END status, l_shipdate FROM (
SELECT l_orderkey, l_linenumber, o_custkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(10,2))) AS DECIMAL(10,2)) l_extendedprice, min(l_partkey) l_partkey, min(l_returnflag) l_returnflag, min(l_linestatus) l_linestatus, min(l_shipdate) l_shipdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_linenumber, o_custkey) g) x""",
    "staff": """
SELECT s_suppkey staff_id, s_name name, CASE WHEN s_suppkey % 2 = 0 THEN '男' ELSE '女' END gender, CAST(13900000000 + s_suppkey AS VARCHAR) phone,
CASE s_suppkey % 4 WHEN 0 THEN '维修工' WHEN 1 THEN '保安' WHEN 2 THEN '保洁' ELSE '经理' END role, CAST(abs(s_acctbal) AS DECIMAL(10,2)) salary,
CAST('2010-01-01' AS DATE) + CAST(s_suppkey % 1000 AS INT) hire_date,
CASE WHEN s_suppkey % 10 = 9 THEN '离职' ELSE '在职' END status FROM supplier""",
    "repair_orders": """
SELECT o_orderkey order_id, o_custkey resident_id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderkey % 10 END staff_id, 'R' || CAST(o_orderkey AS VARCHAR) title,
CASE o_orderpriority WHEN '1-URGENT' THEN '紧急' WHEN '2-HIGH' THEN '高' WHEN '5-LOW' THEN '低' ELSE '中' END priority,
CASE WHEN o_orderkey % 13 = 12 THEN '已取消' WHEN o_orderstatus = 'F' THEN '已完成' WHEN o_orderstatus = 'O' THEN '待处理' ELSE '处理中' END status,
o_orderdate created_at, CASE WHEN o_orderkey % 13 <> 12 AND o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY END completed_at FROM orders""",
    "complaints": """
SELECT event_id complaint_id, user_id resident_id, 'C' || CAST(event_id AS VARCHAR) title, props content, CASE event_id % 3 WHEN 0 THEN '投诉' WHEN 1 THEN '建议' ELSE '咨询' END complaint_type,
CASE event_id % 4 WHEN 0 THEN '待处理' WHEN 1 THEN '处理中' WHEN 2 THEN '已解决' ELSE '已关闭' END status, ts created_at FROM events WHERE event_type IN ('error', 'purchase')""",
    "announcements": """
SELECT event_id announcement_id, 'A' || CAST(event_id AS VARCHAR) title, props content, CASE event_id % 4 WHEN 0 THEN '通知' WHEN 1 THEN '公告' WHEN 2 THEN '活动' ELSE '紧急' END ann_type, 'office' publisher, event_id % 17 = 0 is_top, ts created_at FROM events WHERE event_type = 'signup'""",
    "visitor_records": """
SELECT event_id visitor_id, user_id resident_id, 'V' || CAST(event_id AS VARCHAR) visitor_name, CASE event_id % 6 WHEN 0 THEN '探访' WHEN 1 THEN '快递' WHEN 2 THEN '外卖' WHEN 3 THEN '维修' WHEN 4 THEN '商务' ELSE '其他' END purpose, ts entry_time, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL 45 MINUTE END exit_time FROM events WHERE event_type IN ('view', 'click')""",
}

_PROVIDED = {
    "buildings": {"building_id", "building_name", "total_floors", "address"},
    "units": {"unit_id", "building_id", "unit_number", "floors"},
    "rooms": {"room_id", "unit_id", "room_number", "area", "room_type", "status"},
    "residents": {"resident_id", "room_id", "name", "gender", "phone", "id_card", "relationship", "move_in_date"},
    "parking_spaces": {"space_id", "space_number", "area_name", "space_type", "status", "monthly_price"},
    "vehicles": {"vehicle_id", "resident_id", "space_id", "plate_no", "vehicle_type"},
    "fee_categories": {"category_id", "category_name", "billing_cycle", "calc_method", "unit_price"},
    "fee_records": {"fee_id", "resident_id", "category_id", "amount", "paid_amount", "fee_period", "status",
                    "due_date", "paid_date", "created_at"},
    "staff": {"staff_id", "name", "gender", "phone", "role", "salary", "hire_date", "status"},
    "repair_orders": {"order_id", "resident_id", "staff_id", "title", "priority", "status", "created_at",
                      "completed_at"},
    "complaints": {"complaint_id", "resident_id", "title", "content", "complaint_type", "status", "created_at"},
    "announcements": {"announcement_id", "title", "content", "ann_type", "publisher", "is_top", "created_at"},
    "visitor_records": {"visitor_id", "resident_id", "visitor_name", "purpose", "entry_time", "exit_time"},
}


def _conformed(name: str) -> str:
    cols = []
    for c in TABLES[name].columns:
        src = c.name if c.name in _PROVIDED[name] else "NULL"
        cols.append(f"CAST({src} AS {duck_type(c.dtype)}) AS {c.name}")
    return f"SELECT {', '.join(cols)} FROM ({_DERIVED[name].strip()}) src"


def estate_ctes() -> list[tuple[str, str]]:
    return [(n, _conformed(n)) for n in TABLES]


def with_estate(body: str, extra: list[tuple[str, str]] | None = None, recursive: bool = False) -> str:
    """``body`` prefixed by the estate tables (and any extra CTEs) as a WITH clause."""
    ctes = estate_ctes() + list(extra or [])
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + body.strip()


def rank_case(col: str, values) -> str:
    whens = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values, 1))
    return f"CAST(CASE {col} {whens} ELSE 0 END AS BIGINT)"


def pct(part: str, whole: str) -> str:
    """One-decimal percentage text, half up, in integers (matches functions.percent_text)."""
    t = f"(({part}) * 2000 + ({whole})) // (2 * ({whole}))"
    return (f"CASE WHEN ({whole}) = 0 OR ({part}) IS NULL THEN NULL ELSE "
            f"CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR) || '%' END")


def cnt_if(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


ADDR = "b.building_name || ' ' || u.unit_number || ' ' || r.room_number"
CHAIN = ("JOIN rooms r ON res.room_id = r.room_id JOIN units u ON r.unit_id = u.unit_id "
         "JOIN buildings b ON u.building_id = b.building_id")


def _cols(table: str, alias: str) -> str:
    return ", ".join(f"{alias}.{c}" for c in TABLES[table].names)


REPAIR_ORDER, COMPLAINT_ORDER = REPAIR_STATUS, COMPLAINT_STATUS

REPORTS = {
    "dashboard": f"""
SELECT (SELECT count(*) FROM buildings) buildings,
       (SELECT count(*) FROM rooms) rooms_total,
       (SELECT {cnt_if("status = '已入住'")} FROM rooms) rooms_occupied,
       (SELECT count(*) FROM residents) residents,
       (SELECT count(*) FROM parking_spaces) parking_total,
       (SELECT {cnt_if("status = '空闲'")} FROM parking_spaces) parking_available,
       (SELECT count(*) FROM repair_orders) repairs_total,
       (SELECT {cnt_if("status IN ('待处理','处理中')")} FROM repair_orders) repairs_pending,
       (SELECT count(*) FROM complaints) complaints_total,
       (SELECT {cnt_if("status = '待处理'")} FROM complaints) complaints_pending,
       (SELECT count(*) FROM fee_records) fees_total,
       (SELECT {cnt_if("status IN ('待缴','逾期')")} FROM fee_records) fees_unpaid""",
    "latest_announcements": """
SELECT * FROM announcements ORDER BY is_top DESC, created_at DESC NULLS LAST, announcement_id DESC LIMIT 5""",
    "community_summary": """
SELECT (SELECT count(*) FROM buildings) buildings, (SELECT count(*) FROM units) units,
       (SELECT count(*) FROM rooms) rooms, (SELECT count(*) FROM residents) residents,
       (SELECT count(*) FROM parking_spaces) parking_spaces, (SELECT count(*) FROM vehicles) vehicles,
       (SELECT count(*) FROM staff) staff""",
    "table_counts": " UNION ALL ".join(
        f"SELECT '{n}' table_name, count(*) row_count FROM {n}" for n in TABLES),
    "building_rollup": f"""
SELECT {_cols("buildings", "b")}, CAST(count(DISTINCT u.unit_id) AS BIGINT) unit_count,
       CAST(count(DISTINCT r.room_id) AS BIGINT) room_count
FROM buildings b LEFT JOIN units u ON u.building_id = b.building_id LEFT JOIN rooms r ON r.unit_id = u.unit_id
GROUP BY {_cols("buildings", "b")}""",
    "unit_rollup": f"""
SELECT {_cols("units", "u")}, b.building_name, CAST(count(DISTINCT r.room_id) AS BIGINT) room_count
FROM units u JOIN buildings b ON u.building_id = b.building_id LEFT JOIN rooms r ON r.unit_id = u.unit_id
GROUP BY {_cols("units", "u")}, b.building_name""",
    "room_list": f"""
SELECT r.*, b.building_name, u.unit_number, {ADDR} full_address
FROM rooms r JOIN units u ON r.unit_id = u.unit_id JOIN buildings b ON u.building_id = b.building_id""",
    "vacant_rooms": f"""
SELECT r.*, b.building_name, u.unit_number, {ADDR} full_address
FROM rooms r JOIN units u ON r.unit_id = u.unit_id JOIN buildings b ON u.building_id = b.building_id
WHERE r.status = '空置'""",
    "resident_list": f"""
SELECT res.*, r.room_number, r.area, b.building_name, u.unit_number, {ADDR} full_address
FROM residents res {CHAIN}""",
    "resident_overview": f"""
SELECT res.resident_id, res.name, res.gender, res.phone, res.id_card, res.relationship, res.move_in_date,
       r.room_number, r.area, r.room_type, {ADDR} full_address,
       (SELECT count(*) FROM vehicles v WHERE v.resident_id = res.resident_id) vehicle_count,
       (SELECT count(*) FROM repair_orders ro WHERE ro.resident_id = res.resident_id) repair_count,
       (SELECT count(*) FROM complaints c WHERE c.resident_id = res.resident_id) complaint_count
FROM residents res {CHAIN}""",
    "resident_unpaid": """
SELECT fr.fee_id, fr.resident_id, fc.category_name, fr.amount, fr.paid_amount,
       CAST(fr.amount - fr.paid_amount AS DECIMAL(10,2)) remaining, fr.fee_period, fr.due_date
FROM fee_records fr JOIN fee_categories fc ON fr.category_id = fc.category_id
WHERE fr.status != '已缴'""",
    "resident_recent_repairs": """
SELECT resident_id, order_id, title, priority, status, created_at, recent_rank FROM (
  SELECT resident_id, order_id, title, priority, status, created_at,
         CAST(row_number() OVER (PARTITION BY resident_id ORDER BY created_at DESC NULLS LAST, order_id DESC) AS BIGINT) recent_rank
  FROM repair_orders) x WHERE recent_rank <= 5""",
    "parking_list": f"""
SELECT {_cols("parking_spaces", "ps")}, v.plate_no, v.vehicle_type, res.name resident_name
FROM parking_spaces ps LEFT JOIN vehicles v ON v.space_id = ps.space_id
LEFT JOIN residents res ON v.resident_id = res.resident_id""",
    "parking_overview": f"""
SELECT count(*) total_spaces, {cnt_if("status = '空闲'")} available, {cnt_if("status = '已租'")} rented,
       {cnt_if("status = '已售'")} sold, {cnt_if("status = '维修中'")} under_maintenance,
       {pct(cnt_if("status IN ('已租','已售')"), "count(*)")} occupancy_rate
FROM parking_spaces""",
    "parking_by_area": f"""
SELECT area_name, count(*) total, {cnt_if("status = '空闲'")} available FROM parking_spaces GROUP BY area_name""",
    "vehicle_list": f"""
SELECT {_cols("vehicles", "v")}, res.name resident_name, ps.space_number
FROM vehicles v JOIN residents res ON v.resident_id = res.resident_id
LEFT JOIN parking_spaces ps ON v.space_id = ps.space_id""",
    "fee_list": f"""
SELECT {_cols("fee_records", "fr")}, fc.category_name, res.name resident_name, {ADDR} full_address,
       CAST(fr.amount - fr.paid_amount AS DECIMAL(10,2)) remaining, fr.status != '已缴' payable
FROM fee_records fr JOIN fee_categories fc ON fr.category_id = fc.category_id
JOIN residents res ON fr.resident_id = res.resident_id {CHAIN}""",
    "fee_periods": "SELECT DISTINCT fee_period FROM fee_records",
    "fee_report": f"""
SELECT fee_period, category_id, category_name, total_bills, total_amount, total_paid, total_unpaid, paid_count,
       overdue_count, {pct("paid_count", "total_bills")} payment_rate
FROM (SELECT fr.fee_period, fc.category_id, fc.category_name, count(fr.fee_id) total_bills,
             CAST(sum(fr.amount) AS DECIMAL(20,2)) total_amount, CAST(sum(fr.paid_amount) AS DECIMAL(20,2)) total_paid,
             CAST(sum(fr.amount - fr.paid_amount) AS DECIMAL(20,2)) total_unpaid,
             {cnt_if("fr.status = '已缴'")} paid_count, {cnt_if("fr.status = '逾期'")} overdue_count
      FROM fee_records fr JOIN fee_categories fc ON fr.category_id = fc.category_id
      GROUP BY fr.fee_period, fc.category_id, fc.category_name) x""",
    "fee_category_list": "SELECT * FROM fee_categories",
    "repair_board": f"""
SELECT {_cols("repair_orders", "ro")}, res.name resident_name, res.phone resident_phone, s.name staff_name,
       {ADDR} full_address, {rank_case("ro.status", REPAIR_ORDER)} status_rank
FROM repair_orders ro JOIN residents res ON ro.resident_id = res.resident_id {CHAIN}
LEFT JOIN staff s ON ro.staff_id = s.staff_id""",
    "open_repairs": f"""
SELECT {_cols("repair_orders", "ro")}, res.name resident_name, res.phone resident_phone, s.name staff_name,
       {ADDR} full_address, {rank_case("ro.status", REPAIR_ORDER)} status_rank
FROM repair_orders ro JOIN residents res ON ro.resident_id = res.resident_id {CHAIN}
LEFT JOIN staff s ON ro.staff_id = s.staff_id
WHERE ro.status NOT IN ('已完成', '已取消')""",
    "repair_detail": f"""
SELECT ro.order_id, ro.title, ro.description, ro.location, ro.priority, ro.status, ro.created_at, ro.completed_at,
       res.name resident_name, res.phone resident_phone, {ADDR} full_address, s.name staff_name, s.phone staff_phone
FROM repair_orders ro JOIN residents res ON ro.resident_id = res.resident_id {CHAIN}
LEFT JOIN staff s ON ro.staff_id = s.staff_id""",
    "complaint_board": f"""
SELECT {_cols("complaints", "c")}, res.name resident_name, res.phone resident_phone,
       {rank_case("c.status", COMPLAINT_ORDER)} status_rank
FROM complaints c JOIN residents res ON c.resident_id = res.resident_id""",
    "open_complaints": f"""
SELECT {_cols("complaints", "c")}, res.name resident_name, res.phone resident_phone,
       {rank_case("c.status", COMPLAINT_ORDER)} status_rank
FROM complaints c JOIN residents res ON c.resident_id = res.resident_id
WHERE c.status NOT IN ('已解决', '已关闭')""",
    "announcement_board": "SELECT * FROM announcements",
    "visitor_log": f"""
SELECT {_cols("visitor_records", "v")}, res.name resident_name, {ADDR} full_address, v.exit_time IS NULL is_open
FROM visitor_records v JOIN residents res ON v.resident_id = res.resident_id {CHAIN}""",
    "staff_list": f"SELECT *, {rank_case('status', ('在职', '离职'))} status_rank FROM staff",
    "active_repairers": "SELECT * FROM staff WHERE role = '维修工' AND status = '在职'",
}


# ----------------------------------------------------------------------------- change batches

AS_OF_SQL = "TIMESTAMP '2002-01-01 00:00:00'"
OFFSET = 10_000_000_000

BATCHES = {
    "payments": """
SELECT fee_id, CAST(k AS INTEGER) seq, CAST(CASE (fee_id + k) % 5 WHEN 0 THEN 0 WHEN 1 THEN (amount - paid_amount) * 0.4
  WHEN 2 THEN (amount - paid_amount) * 0.7 WHEN 3 THEN (amount - paid_amount) * 0.6 ELSE 1 END AS DECIMAL(10,2)) pay_amount
FROM (SELECT fee_id, amount, paid_amount, unnest(generate_series(1, 1 + fee_id % 5)) k FROM fee_records) x""",
    "new_bills": """
SELECT res.resident_id, fc.category_id,
       CAST(CASE WHEN res.resident_id % 2 = 0 THEN 0 ELSE 12.34 END AS DECIMAL(10,2)) amount,
       '2030-01' fee_period, DATE '2030-01-25' due_date
FROM residents res CROSS JOIN fee_categories fc""",
    "repair_changes": """
SELECT order_id, CASE order_id % 9 WHEN 0 THEN '已完成' WHEN 1 THEN '处理中' WHEN 2 THEN '待处理' ELSE status END status
FROM repair_orders""",
    "complaint_changes": """
SELECT complaint_id, CASE complaint_id % 3 WHEN 1 THEN '已解决' WHEN 2 THEN '处理中' ELSE status END status,
       CASE WHEN complaint_id % 3 = 1 THEN 'done' END reply
FROM complaints""",
    "new_residents": f"""
SELECT resident_id + {OFFSET} resident_id, room_id - room_id % 7 + 6 room_id, name,
       CASE WHEN resident_id % 13 = 0 THEN '未知' ELSE gender END gender, phone,
       CASE WHEN resident_id % 17 = 0 THEN id_card WHEN resident_id % 19 = 0 THEN CAST(CAST(id_card AS DECIMAL(20,0)) + {OFFSET} + 1 AS VARCHAR)
            ELSE CAST(CAST(id_card AS DECIMAL(20,0)) + {OFFSET} AS VARCHAR) END id_card,
       CASE WHEN resident_id % 3 = 0 THEN NULL ELSE relationship END relationship, move_in_date
FROM residents""",
    "staff_changes": "SELECT staff_id, CASE WHEN staff_id % 5 = 4 THEN '离职' ELSE status END status FROM staff",
    "vehicle_changes": """
SELECT vehicle_id, CASE vehicle_id % 3 WHEN 0 THEN '黑' WHEN 1 THEN '白' END color,
       CASE WHEN vehicle_id % 3 = 2 THEN '电动车' ELSE vehicle_type END vehicle_type
FROM vehicles""",
    "repair_assignments": """
SELECT order_id, CAST(CASE WHEN order_id % 3 = 0 THEN NULL ELSE (order_id % 10 + 1) * 4 END AS BIGINT) staff_id
FROM repair_orders WHERE status IN ('待处理', '处理中')""",
}


def with_batches(body: str, *names: str, recursive: bool = False, extra=None) -> tuple:
    return (body, [(n, BATCHES[n]) for n in names] + list(extra or []), recursive)


PRICE = ("CAST(CASE WHEN {given} = 0 THEN CASE fc.calc_method WHEN '按面积' THEN ROUND(fc.unit_price * {area}, 2) "
         "WHEN '固定' THEN fc.unit_price ELSE {given} END ELSE {given} END AS DECIMAL(10,2))")

_OK = ("(w.known AND w.st_before <> '已缴' AND w.amt > 0 AND w.paid_before + w.amt <= w.amount)")
_T2 = ("CASE WHEN w.paid_before + w.amt >= w.amount AND w.paid_before + w.amt > 0 THEN '已缴' "
       "WHEN w.paid_before + w.amt > 0 AND w.paid_before + w.amt < w.amount THEN '部分缴纳' ELSE w.st_before END")
_WALK = [
    ("pay", "SELECT fee_id, seq, pay_amount amt, row_number() OVER (PARTITION BY fee_id ORDER BY seq, pay_amount) rn "
            "FROM payments"),
    ("walk", f"""
SELECT p.fee_id, p.rn, p.seq, p.amt, f.fee_id IS NOT NULL known, f.amount,
       CAST(f.paid_amount AS DECIMAL(10,2)) paid_before, f.status st_before
FROM pay p LEFT JOIN fee_records f ON p.fee_id = f.fee_id WHERE p.rn = 1
UNION ALL
SELECT p.fee_id, p.rn, p.seq, p.amt, w.known, w.amount,
       CAST(CASE WHEN {_OK} THEN w.paid_before + w.amt ELSE w.paid_before END AS DECIMAL(10,2)),
       CASE WHEN {_OK} THEN {_T2} ELSE w.st_before END
FROM walk w JOIN pay p ON p.fee_id = w.fee_id AND p.rn = w.rn + 1"""),
    ("steps", f"""
SELECT fee_id, seq, amt pay_amount,
       CASE WHEN NOT known THEN 'UNKNOWN_FEE' WHEN st_before = '已缴' THEN 'ALREADY_PAID'
            WHEN amt IS NULL OR amt <= 0 THEN 'NON_POSITIVE' WHEN paid_before + amt > amount THEN 'OVERPAY'
            ELSE 'OK' END reason,
       CAST(CASE WHEN {_OK.replace('w.', '')} THEN paid_before + amt ELSE paid_before END AS DECIMAL(10,2)) paid_after,
       CASE WHEN {_OK.replace('w.', '')} THEN {_T2.replace('w.', '')} ELSE st_before END status_after
FROM walk"""),
]

WRITES = {
    "bill_amounts": with_batches(f"""
SELECT nb.resident_id, nb.category_id, {PRICE.format(given="nb.amount", area="ra.area")} amount, nb.fee_period, nb.due_date
FROM new_bills nb LEFT JOIN fee_categories fc ON nb.category_id = fc.category_id
LEFT JOIN (SELECT res.resident_id, r.area FROM residents res JOIN rooms r ON res.room_id = r.room_id) ra
  ON ra.resident_id = nb.resident_id""", "new_bills"),
    "generate_bills": with_batches(f"""
SELECT (SELECT coalesce(max(fee_id), 0) FROM fee_records)
         + row_number() OVER (ORDER BY pv.fee_period, res.resident_id, fc.category_id) fee_id,
       res.resident_id, fc.category_id, {PRICE.format(given="0", area="r.area")} amount,
       CAST(0 AS DECIMAL(10,2)) paid_amount, pv.fee_period, '待缴' status, pv.due_date, CAST(NULL AS DATE) paid_date,
       {AS_OF_SQL} created_at
FROM residents res JOIN rooms r ON res.room_id = r.room_id CROSS JOIN fee_categories fc CROSS JOIN pv
WHERE NOT EXISTS (SELECT 1 FROM fee_records fr WHERE fr.resident_id = res.resident_id
                  AND fr.category_id = fc.category_id AND fr.fee_period = pv.fee_period)""",
        extra=[("pv", "SELECT fee_period, CAST(try_strptime(fee_period || '-25', '%Y-%m-%d') AS DATE) due_date "
                      "FROM (VALUES ('1998-03'), ('2030-01'), ('2030-13')) v(fee_period) "
                      "WHERE try_strptime(fee_period || '-25', '%Y-%m-%d') IS NOT NULL")]),
    "payment_status": f"""
SELECT fee_id, amount, paid_amount,
       CASE WHEN paid_amount >= amount AND paid_amount > 0 THEN '已缴'
            WHEN paid_amount > 0 AND paid_amount < amount THEN '部分缴纳' ELSE status END status,
       CASE WHEN paid_amount >= amount AND paid_amount > 0 THEN CAST({AS_OF_SQL} AS DATE) ELSE paid_date END paid_date
FROM fee_records""",
    "post_payments": with_batches("SELECT * FROM steps", "payments", recursive=True, extra=_WALK),
    "ledger_after_payments": with_batches(f"""
SELECT f.fee_id, f.resident_id, f.category_id, fc.category_name, f.amount,
       coalesce(l.paid_after, f.paid_amount) paid_amount,
       CAST(f.amount - coalesce(l.paid_after, f.paid_amount) AS DECIMAL(10,2)) remaining,
       coalesce(l.status_after, f.status) status,
       CASE WHEN l.closed_now = 1 THEN CAST({AS_OF_SQL} AS DATE) ELSE f.paid_date END paid_date, f.fee_period
FROM fee_records f
LEFT JOIN (SELECT fee_id, arg_max(paid_after, seq) paid_after, arg_max(status_after, seq) status_after,
                  max(CASE WHEN reason = 'OK' AND status_after = '已缴' THEN 1 END) closed_now
           FROM steps GROUP BY fee_id) l ON f.fee_id = l.fee_id
LEFT JOIN fee_categories fc ON f.category_id = fc.category_id""", "payments", recursive=True, extra=_WALK),
    "repair_completion": with_batches(f"""
SELECT {", ".join(("coalesce(c.status, o.status) status" if c == "status" else
                   f"CASE WHEN c.status = '已完成' AND o.status <> '已完成' THEN {AS_OF_SQL} ELSE o.completed_at END completed_at"
                   if c == "completed_at" else f"o.{c}") for c in TABLES["repair_orders"].names)}
FROM repair_orders o LEFT JOIN repair_changes c ON o.order_id = c.order_id""", "repair_changes"),
    "complaint_resolution": with_batches(f"""
SELECT {", ".join(("CASE WHEN c.complaint_id IS NOT NULL THEN c.status ELSE o.status END status" if c == "status" else
                   "CASE WHEN c.complaint_id IS NOT NULL THEN c.reply ELSE o.reply END reply" if c == "reply" else
                   f"CASE WHEN c.status = '已解决' AND o.status <> '已解决' THEN {AS_OF_SQL} ELSE o.resolved_at END resolved_at"
                   if c == "resolved_at" else f"o.{c}") for c in TABLES["complaints"].names)}
FROM complaints o LEFT JOIN complaint_changes c ON o.complaint_id = c.complaint_id""", "complaint_changes"),
    "room_occupancy": with_batches(f"""
SELECT {", ".join(("CASE WHEN r.room_id IN (SELECT room_id FROM accepted) THEN '已入住' ELSE r.status END status"
                   if c == "status" else f"r.{c}") for c in TABLES["rooms"].names)}
FROM rooms r""", "new_residents"),
    "staff_resignation": with_batches(f"""
SELECT {", ".join(("CASE WHEN g.staff_id IS NOT NULL AND o.status IN ('待处理','处理中') THEN NULL ELSE o.staff_id END staff_id"
                   if c == "staff_id" else
                   "CASE WHEN g.staff_id IS NOT NULL AND o.status IN ('待处理','处理中') THEN '待处理' ELSE o.status END status"
                   if c == "status" else f"o.{c}") for c in TABLES["repair_orders"].names)}
FROM repair_orders o LEFT JOIN (SELECT s.staff_id FROM staff s JOIN staff_changes c ON s.staff_id = c.staff_id
                                WHERE s.status = '在职' AND c.status = '离职') g ON o.staff_id = g.staff_id""",
        "staff_changes"),
    "apply_inserts": with_batches(f"""
SELECT {_cols("residents", "r")} FROM residents r UNION ALL SELECT {_cols("residents", "a")} FROM accepted a""", "new_residents"),
    "apply_updates": with_batches(f"""
SELECT {", ".join((f"CASE WHEN c.vehicle_id IS NOT NULL THEN c.{c} ELSE v.{c} END {c}" if c in ("color", "vehicle_type")
                   else f"v.{c}") for c in TABLES["vehicles"].names)}
FROM vehicles v LEFT JOIN vehicle_changes c ON v.vehicle_id = c.vehicle_id""", "vehicle_changes"),
    "visit_exit": f"""
SELECT {", ".join((f"CASE WHEN v.exit_time IS NULL THEN {AS_OF_SQL} ELSE v.exit_time END exit_time"
                   if c == "exit_time" else f"v.{c}") for c in TABLES["visitor_records"].names)}
FROM visitor_records v""",
    "repair_assignment": with_batches(f"""
SELECT {", ".join(("CASE WHEN a.order_id IS NOT NULL THEN a.staff_id ELSE o.staff_id END staff_id" if c == "staff_id" else
                   "CASE WHEN a.order_id IS NULL THEN o.status WHEN a.staff_id IS NULL THEN '待处理' ELSE '处理中' END status"
                   if c == "status" else f"o.{c}") for c in TABLES["repair_orders"].names)}
FROM repair_orders o LEFT JOIN repair_assignments a ON o.order_id = a.order_id""", "repair_assignments"),
    "set_null_on_delete": f"""
SELECT {", ".join(("CASE WHEN v.space_id IN (SELECT space_id FROM parking_spaces WHERE status = '维修中') THEN NULL "
                   "ELSE v.space_id END space_id" if c == "space_id" else f"v.{c}") for c in TABLES["vehicles"].names)}
FROM vehicles v""",
    "cascade_delete": """
SELECT 'buildings' table_name, count(*) deleted_rows FROM gb UNION ALL
SELECT 'units', count(*) FROM gu UNION ALL SELECT 'rooms', count(*) FROM gr UNION ALL
SELECT 'residents', count(*) FROM gres UNION ALL
SELECT 'vehicles', count(*) FROM vehicles WHERE resident_id IN (SELECT resident_id FROM gres) UNION ALL
SELECT 'fee_records', count(*) FROM fee_records WHERE resident_id IN (SELECT resident_id FROM gres) UNION ALL
SELECT 'repair_orders', count(*) FROM repair_orders WHERE resident_id IN (SELECT resident_id FROM gres) UNION ALL
SELECT 'complaints', count(*) FROM complaints WHERE resident_id IN (SELECT resident_id FROM gres) UNION ALL
SELECT 'visitor_records', count(*) FROM visitor_records WHERE resident_id IN (SELECT resident_id FROM gres)""",
}
WRITES["cascade_delete"] = (WRITES["cascade_delete"], [
    ("gb", "SELECT building_id FROM buildings WHERE address IS NULL"),
    ("gu", "SELECT unit_id FROM units WHERE building_id IN (SELECT building_id FROM gb)"),
    ("gr", "SELECT room_id FROM rooms WHERE unit_id IN (SELECT unit_id FROM gu)"),
    ("gres", "SELECT resident_id FROM residents WHERE room_id IN (SELECT room_id FROM gr)"),
], False)


# ----------------------------------------------------------------------------- integrity (on dirtied tables)

def _dirty_ctes() -> list[tuple[str, str]]:
    from .sources.dirty import twin_sql
    return [(f"d_{n}", f"SELECT * FROM {n} UNION ALL {twin_sql(n)}") for n in TABLES]


def _norm(c: str) -> str:
    return f"lower(rtrim(strip_accents({c})))"


def _integrity() -> dict:
    pk = " UNION ALL ".join(
        f"SELECT '{n}' table_name, {s.key} key_value, count(*) n FROM d_{n} GROUP BY {s.key} "
        f"HAVING count(*) > 1 OR {s.key} IS NULL" for n, s in TABLES.items())
    uq = []
    for n, s in TABLES.items():
        for cols in s.uniques:
            text = [c for c in cols if s.column(c).dtype == "string"]
            grp = ", ".join(_norm(c) if c in text else c for c in cols)
            shown = " || '|' || ".join(f"min({c})" if c in text else f"CAST({c} AS VARCHAR)" for c in cols)
            uq.append(f"SELECT '{n}' table_name, '{','.join(cols)}' constraint_name, {shown} key_text, count(*) n "
                      f"FROM d_{n} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)} "
                      f"GROUP BY {grp} HAVING count(*) > 1")
    fk = []
    for n, s in TABLES.items():
        for r in s.refs:
            fk.append(f"SELECT '{n}' table_name, '{r.column}' column_name, c.{s.key} row_key, c.{r.column} ref_value "
                      f"FROM d_{n} c WHERE c.{r.column} IS NOT NULL AND NOT EXISTS "
                      f"(SELECT 1 FROM d_{r.parent} p WHERE p.{r.parent_key} = c.{r.column})")
    nulls, lens, chk, enum = [], [], [], []
    for n, s in TABLES.items():
        for c in s.columns:
            if not c.nullable:
                nulls.append(f"SELECT '{n}' table_name, '{c.name}' column_name, "
                             f"CAST(count(*) FILTER (WHERE {c.name} IS NULL) AS BIGINT) null_rows FROM d_{n}")
            if c.length is not None:
                lens.append(f"SELECT '{n}' table_name, '{c.name}' column_name, "
                            f"CAST(count(*) FILTER (WHERE length({c.name}) > {c.length}) AS BIGINT) too_long FROM d_{n}")
            if c.domain:
                dom = ", ".join(f"'{v}'" for v in c.domain)
                enum.append(f"SELECT '{n}' table_name, '{c.name}' column_name, {s.key} row_key, {c.name} value "
                            f"FROM d_{n} WHERE {c.name} NOT IN ({dom})")
        for rule, cond in s.checks:
            chk.append(f"SELECT '{n}' table_name, '{rule}' rule_name, {s.key} row_key FROM d_{n} WHERE NOT ({cond})")
    return {
        "pk_duplicates": pk,
        "unique_violations": " UNION ALL ".join(uq),
        "fk_orphans": " UNION ALL ".join(fk),
        "null_violations": f"SELECT * FROM ({' UNION ALL '.join(nulls)}) x WHERE null_rows > 0",
        "length_violations": f"SELECT * FROM ({' UNION ALL '.join(lens)}) x WHERE too_long > 0",
        "check_violations": " UNION ALL ".join(chk),
        "enum_violations": " UNION ALL ".join(enum),
    }


INTEGRITY = {k: (v, _dirty_ctes(), False) for k, v in _integrity().items()}
INTEGRITY["duplicate_bills"] = """
SELECT resident_id, category_id, fee_period, count(*) n FROM fee_records
GROUP BY resident_id, category_id, fee_period HAVING count(*) > 1"""


def insert_ctes(table: str, batch: str) -> list[tuple[str, str]]:
    """CTEs of an insert batch taken in key order: ``refused`` (key, reason) and ``accepted`` rows.

    Of batch rows that break no other rule and share a unique key the first is taken.  (Enough for
    batches whose primary keys differ and whose table has one unique rule, as here.)
    """
    later = []
    s = TABLES[table]
    k = s.key
    filled = ", ".join(
        f"{AS_OF_SQL} AS {c.name}" if c.default_now and c.name not in _PROVIDED.get(table, set())
        else (f"coalesce({c.name}, '{c.default}') AS {c.name}" if isinstance(c.default, str) else c.name)
        for c in s.columns if c.name in _PROVIDED[table] or c.default_now)
    parts = []
    for c in s.columns:
        if c.name not in _PROVIDED[table] and not c.default_now:
            if not c.nullable:
                parts.append(f"SELECT {k}, 'NULL:{c.name}' reason FROM nb")
            continue
        if not c.nullable:
            parts.append(f"SELECT {k}, 'NULL:{c.name}' reason FROM nb WHERE {c.name} IS NULL")
        if c.domain:
            dom = ", ".join(f"'{v}'" for v in c.domain)
            parts.append(f"SELECT {k}, 'ENUM:{c.name}' reason FROM nb WHERE {c.name} NOT IN ({dom})")
        if c.length is not None:
            parts.append(f"SELECT {k}, 'LENGTH:{c.name}' reason FROM nb WHERE length({c.name}) > {c.length}")
    for rule, cond in s.checks:
        parts.append(f"SELECT {k}, 'CHECK:{rule}' reason FROM nb WHERE NOT ({cond})")
    for r in s.refs:
        parts.append(f"SELECT {k}, 'FK:{r.column}' reason FROM nb WHERE {r.column} IS NOT NULL AND NOT EXISTS "
                     f"(SELECT 1 FROM {r.parent} p WHERE p.{r.parent_key} = nb.{r.column})")
    for cols, label in [((k,), "PK")] + [(u, "UNIQUE:" + ",".join(u)) for u in s.uniques]:
        def n(alias, c):
            return f"{_norm(f'{alias}.{c}')}" if label != "PK" and s.column(c).dtype == "string" else f"{alias}.{c}"
        same = " AND ".join(f"{n('x', c)} = {n('nb', c)}" for c in cols)
        parts.append(f"SELECT {k}, '{label}' reason FROM nb WHERE EXISTS (SELECT 1 FROM {table} x WHERE {same})")
        later.append(f"SELECT {k}, '{label}' reason FROM valid nb WHERE EXISTS (SELECT 1 FROM valid x WHERE {same} AND x.{k} < nb.{k})")
    return [("nb", f"SELECT {filled} FROM {batch}"),
            ("broken", "SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ") r"),
            ("valid", f"SELECT * FROM nb WHERE {k} NOT IN (SELECT {k} FROM broken)"),
            ("refused", "SELECT * FROM broken UNION SELECT * FROM (" + " UNION ALL ".join(later) + ") r"),
            ("accepted", f"SELECT * FROM nb WHERE {k} NOT IN (SELECT {k} FROM refused)")]


for _key in ("room_occupancy", "apply_inserts"):
    WRITES[_key] = (WRITES[_key][0], WRITES[_key][1] + insert_ctes("residents", "new_residents"), False)
WRITES["insert_rejects"] = with_batches("SELECT * FROM refused", "new_residents",
                                        extra=insert_ctes("residents", "new_residents"))

# ----------------------------------------------------------------------------- forms with a parameter or a second result

WRITES["staff_after_resignation"] = with_batches(f"""
SELECT {", ".join("coalesce(c.status, s.status) status" if c == "status" else f"s.{c}" for c in TABLES["staff"].names)}
FROM staff s LEFT JOIN staff_changes c ON s.staff_id = c.staff_id""", "staff_changes")
_GONE = WRITES["cascade_delete"][1]
for _n in ("residents", "vehicles", "fee_records"):
    WRITES[f"cascade_survivors_{_n}"] = (f"SELECT * FROM {_n} WHERE resident_id NOT IN (SELECT resident_id FROM gres)",
                                         _GONE, False)
WRITES["fee_list_period"] = REPORTS["fee_list"] + "\nWHERE fr.fee_period = '1998-03'"
WRITES["fee_report_period"] = f"SELECT * FROM ({REPORTS['fee_report']}) y WHERE fee_period = '1998-03'"
WRITES["repair_detail_open"] = REPORTS["repair_detail"] + "\nWHERE ro.status IN ('待处理', '处理中')"


# ----------------------------------------------------------------------------- updates as a set, dispatch, change log

BATCHES["resident_changes"] = """
SELECT resident_id, CASE WHEN resident_id % 17 = 3 THEN room_id + 10000000000 ELSE room_id END room_id,
       CASE WHEN resident_id % 13 = 5 THEN '未知' ELSE gender END gender, CAST(13900000000 + resident_id AS VARCHAR) phone,
       CASE WHEN resident_id % 11 IN (0, 3, 4, 7) THEN CAST(110101190000000000 + resident_id + 1 AS VARCHAR)
            WHEN resident_id % 11 = 1 THEN CAST(110101190000000000 + resident_id - 1 AS VARCHAR)
            WHEN resident_id % 11 = 5 THEN CAST(110101190000000000 + resident_id + 10000000000 AS VARCHAR)
            WHEN resident_id % 11 IN (9, 10) THEN CAST(110101190000000000 + resident_id - resident_id % 11 + 10000000000 AS VARCHAR)
            ELSE id_card END id_card
FROM residents"""
BATCHES["fee_changes"] = """
SELECT fee_id, CAST(CASE fee_id % 3 WHEN 0 THEN amount WHEN 1 THEN amount * 0.5 ELSE paid_amount END AS DECIMAL(10,2)) paid_amount
FROM fee_records"""

_SET = [
    ("broken", "SELECT resident_id, 'ENUM:gender' reason FROM resident_changes WHERE gender NOT IN ('男', '女') UNION ALL "
               "SELECT c.resident_id, 'FK:room_id' FROM resident_changes c WHERE NOT EXISTS (SELECT 1 FROM rooms r WHERE r.room_id = c.room_id)"),
    ("mover", "SELECT c.resident_id, c.id_card want FROM resident_changes c JOIN residents r ON r.resident_id = c.resident_id "
              "WHERE c.id_card <> r.id_card AND c.resident_id NOT IN (SELECT resident_id FROM broken)"),
    ("firsts", "SELECT want, min(resident_id) resident_id FROM mover GROUP BY want"),
    ("held", "SELECT f.resident_id, h.resident_id holder FROM firsts f JOIN residents h ON h.id_card = f.want"),
    ("stuck", "SELECT resident_id FROM held WHERE holder NOT IN (SELECT resident_id FROM firsts) UNION "
              "SELECT h.resident_id FROM held h JOIN stuck s ON h.holder = s.resident_id"),
    ("unable", "SELECT resident_id, reason FROM broken UNION ALL SELECT resident_id, 'UNIQUE:id_card' FROM mover "
               "WHERE resident_id NOT IN (SELECT resident_id FROM firsts) UNION ALL SELECT resident_id, 'UNIQUE:id_card' FROM stuck"),
]
WRITES["update_rejects"] = with_batches("SELECT * FROM unable", "resident_changes", recursive=True, extra=_SET)
WRITES["residents_after_updates"] = with_batches(f"""
SELECT {", ".join(f"CASE WHEN u.resident_id IS NULL THEN c.{c} ELSE r.{c} END {c}" if c in ("room_id", "gender", "phone", "id_card")
                  else f"r.{c}" for c in TABLES["residents"].names)}
FROM residents r JOIN resident_changes c ON c.resident_id = r.resident_id
LEFT JOIN (SELECT DISTINCT resident_id FROM unable) u ON u.resident_id = r.resident_id""", "resident_changes", recursive=True, extra=_SET)

for _key, _same in (("dispatch_repair_orders", "repair_completion"), ("dispatch_complaints", "complaint_resolution"),
                    ("dispatch_rooms", "room_occupancy"), ("dispatch_orders_of_staff", "staff_resignation")):
    WRITES[_key] = WRITES[_same]
_NOW = "coalesce(c.paid_amount, f.paid_amount)"
WRITES["dispatch_fee_records"] = with_batches(f"""
SELECT {", ".join(f"{_NOW} paid_amount" if c == "paid_amount" else
                  f"CASE WHEN {_NOW} >= f.amount AND {_NOW} > 0 THEN '已缴' WHEN {_NOW} > 0 AND {_NOW} < f.amount THEN '部分缴纳' ELSE f.status END status"
                  if c == "status" else
                  f"CASE WHEN {_NOW} >= f.amount AND {_NOW} > 0 THEN CAST({AS_OF_SQL} AS DATE) ELSE f.paid_date END paid_date"
                  if c == "paid_date" else f"f.{c}" for c in TABLES["fee_records"].names)}
FROM fee_records f LEFT JOIN fee_changes c ON c.fee_id = f.fee_id""", "fee_changes")

# The log walked event by event for each vehicle; owners' and spaces' lives are laid out first.
_CAR = "vehicle_id, resident_id, space_id, color"
_LOG = [
    ("rev", "SELECT resident_id, 100 seq, 'D' op FROM residents WHERE resident_id % 6 = 1 UNION ALL "
            "SELECT resident_id, 200, 'I' FROM residents WHERE resident_id % 12 = 1 UNION ALL "
            "SELECT resident_id, 300, 'D' FROM residents WHERE resident_id % 24 = 1"),
    ("rlife", "SELECT r.resident_id, -1 a, (SELECT min(seq) FROM rev d WHERE d.resident_id = r.resident_id AND d.op = 'D') b FROM residents r "
              "UNION ALL SELECT i.resident_id, i.seq, (SELECT min(seq) FROM rev d WHERE d.resident_id = i.resident_id AND d.op = 'D' AND d.seq > i.seq) "
              "FROM rev i WHERE i.op = 'I'"),
    ("slife", "SELECT space_id, -1 a, CASE WHEN status = '维修中' THEN 150 END b FROM parking_spaces"),
    ("ev0", f"""
SELECT 50 seq, 'U' op, 'color' f, vehicle_id, resident_id, space_id, '红' color FROM vehicles WHERE vehicle_id % 4 = 0 UNION ALL
SELECT 120, 'U', 'resident_id', vehicle_id, vehicle_id + 1, space_id, color FROM vehicles WHERE vehicle_id % 3 = 0 UNION ALL
SELECT 130, 'D', NULL, {_CAR} FROM vehicles WHERE vehicle_id % 10 = 7 UNION ALL
SELECT 140, 'I', NULL, vehicle_id, resident_id, NULL, '新' FROM vehicles WHERE vehicle_id % 10 = 7 UNION ALL
SELECT 160, 'I', NULL, vehicle_id, resident_id, space_id, '拒' FROM vehicles WHERE vehicle_id % 10 = 3 UNION ALL
SELECT 170, 'U', 'space_id', vehicle_id, resident_id, vehicle_id, color FROM vehicles WHERE vehicle_id % 5 = 0 UNION ALL
SELECT 250, 'I', NULL, vehicle_id, resident_id, space_id, '回' FROM vehicles WHERE vehicle_id % 12 = 1 UNION ALL
SELECT 260, 'U', 'color', vehicle_id, resident_id, space_id, '末' FROM vehicles WHERE vehicle_id % 2 = 1"""),
    ("ev", """
SELECT e.*, row_number() OVER (PARTITION BY e.vehicle_id ORDER BY e.seq) rn, e.resident_id IS NULL OR r.resident_id IS NOT NULL rok, r.b rend,
       e.space_id IS NULL OR s.space_id IS NOT NULL sok, s.b send
FROM ev0 e LEFT JOIN rlife r ON r.resident_id = e.resident_id AND r.a < e.seq AND (r.b IS NULL OR r.b > e.seq)
LEFT JOIN slife s ON s.space_id = e.space_id AND s.a < e.seq AND (s.b IS NULL OR s.b > e.seq)"""),
    ("wlk", f"""
SELECT v.vehicle_id, CAST(0 AS BIGINT) rn, -1 seq, true alive, v.resident_id, v.space_id, v.color, v.created_at, r.b rend, s.b send, CAST(NULL AS VARCHAR) why
FROM vehicles v LEFT JOIN rlife r ON r.resident_id = v.resident_id AND r.a = -1 LEFT JOIN slife s ON s.space_id = v.space_id
UNION ALL
SELECT vehicle_id, rn, seq, CASE WHEN op = 'D' THEN false WHEN op = 'I' AND why IS NULL THEN true ELSE live END,
       CASE WHEN (op = 'I' OR f = 'resident_id' AND live) AND why IS NULL THEN n_resident ELSE o_resident END,
       CASE WHEN (op = 'I' OR f = 'space_id' AND live) AND why IS NULL THEN n_space ELSE o_space END,
       CASE WHEN (op = 'I' OR f = 'color' AND live) AND why IS NULL THEN n_color ELSE o_color END,
       CASE WHEN op = 'I' AND why IS NULL THEN {AS_OF_SQL} ELSE created_at END,
       CASE WHEN (op = 'I' OR f = 'resident_id' AND live) AND why IS NULL THEN n_rend ELSE o_rend END,
       CASE WHEN (op = 'I' OR f = 'space_id' AND live) AND why IS NULL THEN n_send ELSE o_send END, why
FROM (SELECT *, CASE WHEN op = 'I' AND live THEN 'PK'
                     WHEN (op = 'I' OR f = 'resident_id' AND live) AND NOT rok THEN 'FK:resident_id'
                     WHEN (op = 'I' OR f = 'space_id' AND live) AND NOT sok THEN 'FK:space_id' END why
      FROM (SELECT e.vehicle_id, e.rn, e.seq, e.op, e.f, e.rok, e.sok, w.alive AND (w.rend IS NULL OR w.rend > e.seq) live,
                   e.resident_id n_resident, e.space_id n_space, e.color n_color, e.rend n_rend, e.send n_send,
                   w.resident_id o_resident, CASE WHEN w.send < e.seq THEN NULL ELSE w.space_id END o_space, w.color o_color, w.created_at,
                   w.rend o_rend, CASE WHEN w.send < e.seq THEN NULL ELSE w.send END o_send
            FROM wlk w JOIN ev e ON e.vehicle_id = w.vehicle_id AND e.rn = w.rn + 1) x) y"""),
    ("fin", "SELECT * FROM wlk QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY rn DESC) = 1"),
]
WRITES["apply_log"] = (f"""
SELECT {", ".join({"resident_id": "f.resident_id", "space_id": "CASE WHEN f.send IS NULL THEN f.space_id END space_id", "color": "f.color",
                   "created_at": "f.created_at"}.get(c, f"v.{c}") for c in TABLES["vehicles"].names)}
FROM fin f JOIN vehicles v ON v.vehicle_id = f.vehicle_id WHERE f.alive AND f.rend IS NULL""", _LOG, True)
WRITES["apply_log_rejects"] = ("SELECT 'vehicles' table_name, vehicle_id row_key, CAST(seq AS BIGINT) seq, why reason FROM wlk WHERE why IS NOT NULL", _LOG, True)


# ----------------------------------------------------------------------------- rules after a batch, small keys

_FILLED = insert_ctes("residents", "new_residents")[0]
_GROWN = [("new_residents", BATCHES["new_residents"]), _FILLED] + [
    (f"d_{n}", f"SELECT {_cols('residents', 'r')} FROM residents r UNION ALL SELECT {_cols('residents', 'nb')} FROM nb UNION ALL "
               f"SELECT {_cols('residents', 'r')} FROM residents r WHERE resident_id % 9 = 0" if n == "residents" else f"SELECT * FROM {n}")
    for n in TABLES]
for _key in ("pk_duplicates", "unique_violations"):
    INTEGRITY[f"{_key}_after"] = (_integrity()[_key], _GROWN, False)
INTEGRITY["duplicate_bills_after"] = """
SELECT resident_id, category_id, fee_period, count(*) n FROM (SELECT * FROM fee_records UNION ALL SELECT * FROM fee_records WHERE fee_id % 5 = 0) x
GROUP BY resident_id, category_id, fee_period HAVING count(*) > 1"""

WRITES["foreign_key_usage"] = " UNION ALL ".join(
    f"SELECT '{n}' table_name, '{r.column}' column_name, '{r.parent}' referenced_table, '{r.parent_key}' referenced_column, "
    f"'{r.on_delete.upper()}' on_delete, count(*) FILTER (WHERE {r.column} IS NOT NULL) referencing_rows, "
    f"count(*) FILTER (WHERE {r.column} IS NULL) empty_rows FROM {n}" for n, s in TABLES.items() for r in s.refs)


def _json_value(c: str, kind: str) -> str:
    text = f"CAST({c} AS VARCHAR)" if kind != "timestamp" else f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%g')"
    return f"coalesce({text}, 'null')" if kind == "number" else f"coalesce('\"' || {text} || '\"', 'null')"


WRITES["staff_json"] = "SELECT staff_id, '{' || " + " || ',' || ".join(
    f"'\"{c}\":' || " + _json_value(c, "number" if c in ("staff_id", "salary") else "timestamp" if c == "created_at" else "text")
    for c in ("staff_id", "name", "gender", "phone", "role", "salary", "hire_date", "status", "created_at")) + " || '}' json FROM staff"
WRITES["sample_unpaid_bill"] = "SELECT fee_id, amount, paid_amount, status FROM fee_records WHERE status = '待缴' ORDER BY fee_id LIMIT 1"
WRITES["sample_open_order"] = "SELECT order_id, status, completed_at FROM repair_orders WHERE status <> '已完成' ORDER BY order_id LIMIT 1"
_DAY, _TIME = "%Y/%-m/%-d", "%Y/%-m/%-d %H:%M:%S"
WRITES["visitor_times"] = f"""
SELECT visitor_id, strftime(entry_time, '{_TIME}') entry_text, coalesce(strftime(exit_time, '{_TIME}'), '未离开') exit_text,
       strftime(entry_time, '{_DAY}') entry_day, coalesce(nullif(remark, ''), '-') remark_text
FROM visitor_records"""
_BELOW = {"buildings": "building_id NOT IN (SELECT building_id FROM gb)", "units": "unit_id NOT IN (SELECT unit_id FROM gu)",
          "rooms": "room_id NOT IN (SELECT room_id FROM gr)"}
for _n in ("buildings", "units", "rooms", "repair_orders", "complaints", "visitor_records"):
    WRITES[f"cascade_survivors_{_n}"] = (
        f"SELECT * FROM {_n} WHERE {_BELOW.get(_n, 'resident_id NOT IN (SELECT resident_id FROM gres)')}", _GONE, False)
