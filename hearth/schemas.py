"""Declared data model of the estate tables, held as data.

Every table is a list of columns with its Spark type, nullability, text
length limit, value domain and default.  The integrity jobs
(:mod:`hearth.operators.integrity`), the change jobs
(:mod:`hearth.operators.changes`) and the readers all drive off these
lists, so a rule is written once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Column:
    name: str
    dtype: str
    nullable: bool = True
    length: int | None = None          # VARCHAR(n) limit
    domain: tuple[str, ...] | None = None   # ENUM values, declaration order
    default: object = None             # value filled in on insert
    default_now: bool = False          # default is the batch's as_of


@dataclass(frozen=True)
class Table:
    name: str
    key: str
    columns: tuple[Column, ...]
    uniques: tuple[tuple[str, ...], ...] = ()
    checks: tuple[tuple[str, str], ...] = ()   # (rule name, SQL predicate that must hold)
    refs: tuple["Reference", ...] = field(default=())

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"{self.name}.{name}")

    @property
    def spark_schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(c.name, spark_type(c.dtype), c.nullable) for c in self.columns]
        )


_SIMPLE = {
    "bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(),
    "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(), "boolean": T.BooleanType(),
}


def spark_type(dtype: str) -> T.DataType:
    if dtype.startswith("decimal("):
        p, s = dtype[8:-1].split(",")
        return T.DecimalType(int(p), int(s))
    return _SIMPLE[dtype]


def duck_type(dtype: str) -> str:
    """The same type spelled for DuckDB (used by the oracle SQL)."""
    return {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE",
            "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}.get(dtype, dtype.upper())


@dataclass(frozen=True)
class Reference:
    column: str
    parent: str
    parent_key: str
    on_delete: str          # "cascade" or "set null"


# --- fixed values: enum domains in declaration order (their sort order) -------------------
ROOM_TYPES = ("住宅", "商铺", "储藏室")
ROOM_STATUS = ("空置", "已入住", "装修中")
GENDERS = ("男", "女")
RELATIONSHIPS = ("业主", "家属", "租客")
SPACE_TYPES = ("普通", "大型", "充电")
SPACE_STATUS = ("空闲", "已租", "已售", "维修中")
VEHICLE_TYPES = ("轿车", "SUV", "电动车", "摩托车")
BILLING_CYCLES = ("月", "季", "年")
CALC_METHODS = ("固定", "按面积", "按用量")
FEE_STATUS = ("待缴", "已缴", "逾期", "部分缴纳")
STAFF_ROLES = ("经理", "维修工", "保安", "保洁")
STAFF_STATUS = ("在职", "离职")
PRIORITIES = ("低", "中", "高", "紧急")
REPAIR_STATUS = ("待处理", "处理中", "已完成", "已取消")
COMPLAINT_TYPES = ("投诉", "建议", "咨询")
COMPLAINT_STATUS = ("待处理", "处理中", "已解决", "已关闭")
ANN_TYPES = ("通知", "公告", "活动", "紧急")
VISIT_PURPOSES = ("探访", "快递", "外卖", "维修", "商务", "其他")

# --- fixed values: status words the jobs test for --------------------------------------
OCCUPIED = "已入住"
VACANT = "空置"
SPACE_FREE = "空闲"
SPACE_RENTED = "已租"
SPACE_SOLD = "已售"
SPACE_REPAIR = "维修中"
FEE_UNPAID = "待缴"
FEE_PAID = "已缴"
FEE_OVERDUE = "逾期"
FEE_PARTIAL = "部分缴纳"
BY_AREA = "按面积"
FIXED = "固定"
BY_USAGE = "按用量"
ORDER_PENDING = "待处理"
ORDER_ACTIVE = "处理中"
ORDER_DONE = "已完成"
ORDER_CANCELLED = "已取消"
COMPLAINT_PENDING = "待处理"
COMPLAINT_SOLVED = "已解决"
COMPLAINT_CLOSED = "已关闭"
STAFF_ACTIVE = "在职"
STAFF_LEFT = "离职"
REPAIRER = "维修工"


def C(name, dtype, nullable=True, length=None, domain=None, default=None, default_now=False):
    return Column(name, dtype, nullable, length, domain, default, default_now)


TABLES: dict[str, Table] = {
    t.name: t
    for t in [
        Table("buildings", "building_id", (
            C("building_id", "bigint", False),
            C("building_name", "string", False, 50),
            C("total_floors", "int", False),
            C("address", "string", True, 200),
            C("created_at", "timestamp_ntz", default_now=True),
        ), uniques=(("building_name",),), checks=(("total_floors_positive", "total_floors > 0"),)),
        Table("units", "unit_id", (
            C("unit_id", "bigint", False),
            C("building_id", "bigint", False),
            C("unit_number", "string", False, 20),
            C("floors", "int", False),
            C("created_at", "timestamp_ntz", default_now=True),
        ), uniques=(("building_id", "unit_number"),), checks=(("floors_positive", "floors > 0"),),
            refs=(Reference("building_id", "buildings", "building_id", "cascade"),)),
        Table("rooms", "room_id", (
            C("room_id", "bigint", False),
            C("unit_id", "bigint", False),
            C("room_number", "string", False, 20),
            C("area", "decimal(10,2)", False),
            C("room_type", "string", False, domain=ROOM_TYPES, default="住宅"),
            C("status", "string", False, domain=ROOM_STATUS, default="空置"),
            C("created_at", "timestamp_ntz", default_now=True),
        ), uniques=(("unit_id", "room_number"),), checks=(("area_positive", "area > 0"),),
            refs=(Reference("unit_id", "units", "unit_id", "cascade"),)),
        Table("residents", "resident_id", (
            C("resident_id", "bigint", False),
            C("room_id", "bigint", False),
            C("name", "string", False, 50),
            C("gender", "string", False, domain=GENDERS),
            C("phone", "string", False, 20),
            C("id_card", "string", False, 18),
            C("relationship", "string", False, domain=RELATIONSHIPS, default="业主"),
            C("move_in_date", "date", False),
            C("created_at", "timestamp_ntz", default_now=True),
        ), uniques=(("id_card",),),
            refs=(Reference("room_id", "rooms", "room_id", "cascade"),)),
        Table("parking_spaces", "space_id", (
            C("space_id", "bigint", False),
            C("space_number", "string", False, 20),
            C("area_name", "string", False, 50, default="地下停车场"),
            C("space_type", "string", False, domain=SPACE_TYPES, default="普通"),
            C("status", "string", False, domain=SPACE_STATUS, default="空闲"),
            C("monthly_price", "decimal(10,2)", False, default="300.00"),
            C("created_at", "timestamp_ntz", default_now=True),
        ), uniques=(("space_number",),)),
        Table("vehicles", "vehicle_id", (
            C("vehicle_id", "bigint", False),
            C("resident_id", "bigint", False),
            C("space_id", "bigint"),
            C("plate_no", "string", False, 20),
            C("vehicle_type", "string", False, domain=VEHICLE_TYPES, default="轿车"),
            C("color", "string", True, 20),
            C("created_at", "timestamp_ntz", default_now=True),
        ), uniques=(("plate_no",),),
            refs=(Reference("resident_id", "residents", "resident_id", "cascade"),
                  Reference("space_id", "parking_spaces", "space_id", "set null"))),
        Table("fee_categories", "category_id", (
            C("category_id", "bigint", False),
            C("category_name", "string", False, 50),
            C("billing_cycle", "string", False, domain=BILLING_CYCLES, default="月"),
            C("calc_method", "string", False, domain=CALC_METHODS, default="固定"),
            C("unit_price", "decimal(10,4)", False, default="0"),
            C("description", "string", True, 200),
        ), uniques=(("category_name",),)),
        Table("fee_records", "fee_id", (
            C("fee_id", "bigint", False),
            C("resident_id", "bigint", False),
            C("category_id", "bigint", False),
            C("amount", "decimal(10,2)", False),
            C("paid_amount", "decimal(10,2)", False, default="0"),
            C("fee_period", "string", False, 20),
            C("status", "string", False, domain=FEE_STATUS, default="待缴"),
            C("due_date", "date", False),
            C("paid_date", "date"),
            C("created_at", "timestamp_ntz", default_now=True),
        ), refs=(Reference("resident_id", "residents", "resident_id", "cascade"),
                 Reference("category_id", "fee_categories", "category_id", "cascade"))),
        Table("staff", "staff_id", (
            C("staff_id", "bigint", False),
            C("name", "string", False, 50),
            C("gender", "string", False, domain=GENDERS),
            C("phone", "string", False, 20),
            C("role", "string", False, domain=STAFF_ROLES),
            C("salary", "decimal(10,2)", False, default="0"),
            C("hire_date", "date", False),
            C("status", "string", False, domain=STAFF_STATUS, default="在职"),
            C("created_at", "timestamp_ntz", default_now=True),
        )),
        Table("repair_orders", "order_id", (
            C("order_id", "bigint", False),
            C("resident_id", "bigint", False),
            C("staff_id", "bigint"),
            C("title", "string", False, 100),
            C("description", "string"),
            C("location", "string", True, 200),
            C("priority", "string", False, domain=PRIORITIES, default="中"),
            C("status", "string", False, domain=REPAIR_STATUS, default="待处理"),
            C("created_at", "timestamp_ntz", default_now=True),
            C("completed_at", "timestamp_ntz"),
        ), refs=(Reference("resident_id", "residents", "resident_id", "cascade"),
                 Reference("staff_id", "staff", "staff_id", "set null"))),
        Table("complaints", "complaint_id", (
            C("complaint_id", "bigint", False),
            C("resident_id", "bigint", False),
            C("title", "string", False, 100),
            C("content", "string", False),
            C("complaint_type", "string", False, domain=COMPLAINT_TYPES, default="投诉"),
            C("status", "string", False, domain=COMPLAINT_STATUS, default="待处理"),
            C("reply", "string"),
            C("created_at", "timestamp_ntz", default_now=True),
            C("resolved_at", "timestamp_ntz"),
        ), refs=(Reference("resident_id", "residents", "resident_id", "cascade"),)),
        Table("announcements", "announcement_id", (
            C("announcement_id", "bigint", False),
            C("title", "string", False, 200),
            C("content", "string", False),
            C("ann_type", "string", False, domain=ANN_TYPES, default="通知"),
            C("publisher", "string", False, 50),
            C("is_top", "boolean", False, default=False),
            C("created_at", "timestamp_ntz", default_now=True),
        )),
        Table("visitor_records", "visitor_id", (
            C("visitor_id", "bigint", False),
            C("resident_id", "bigint", False),
            C("visitor_name", "string", False, 50),
            C("visitor_phone", "string", True, 20),
            C("purpose", "string", False, domain=VISIT_PURPOSES, default="探访"),
            C("entry_time", "timestamp_ntz", False, default_now=True),
            C("exit_time", "timestamp_ntz"),
            C("remark", "string", True, 200),
        ), refs=(Reference("resident_id", "residents", "resident_id", "cascade"),)),
    ]
}

TABLE_ORDER = list(TABLES)

# Reverse edges of the reference graph: parent -> [(child table, reference)].
CHILDREN: dict[str, list[tuple[str, Reference]]] = {}
for _t in TABLES.values():
    for _r in _t.refs:
        CHILDREN.setdefault(_r.parent, []).append((_t.name, _r))
