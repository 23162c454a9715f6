"""Estate tables derived from the provided TPC-H-style Parquet.

The provided test tables hold no property data, so each estate table is a
projection of one of them (FIXTURES.md §3).  Every builder is plain
DataFrame code: projections and a single lineitem ⋈ orders join, so the
scans prune to the columns used and the work grows with the input.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES, spark_type

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Declared schemas of the provided tables: reading with them skips footer inference.
BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the declared schema; declared columns the source lacks become typed nulls."""
    have = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for c in TABLES[table].columns:
        want = spark_type(c.dtype)
        if have.get(c.name) == want:
            cols.append(F.col(c.name))          # already the declared type: no cast node
        else:
            src = F.col(c.name) if c.name in have else F.lit(None)
            cols.append(src.cast(want).alias(c.name))
    return df.select(*cols)


def literal_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small fixed table as a Spark-side literal (``inline`` of an array of structs).

    Unlike ``createDataFrame`` over a Python list, the plan keeps exact size
    statistics, so joins against it are broadcast.
    """
    fields = [f.strip().split(" ", 1) for f in re.split(r",(?![^()]*\))", ddl)]
    structs = [F.struct(*[F.lit(v).cast(typ).alias(name) for v, (name, typ) in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _case(col: Column, mapping: dict, default) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(col == k, v) if out is None else out.when(col == k, v))
    return out.otherwise(default)


def buildings(spark: SparkSession, region: DataFrame) -> DataFrame:
    k = F.col("r_regionkey")
    b = region.select(
        k.cast("bigint").alias("building_id"),
        F.col("r_name").alias("building_name"),
        F.when(k % 2 == 0, 18).otherwise(6).alias("total_floors"),
        F.when(k == 0, F.lit(None)).otherwise(F.concat(F.lit("Block "), F.col("r_name"))).alias("address"),
    )
    extra = literal_rows(spark, [(99, "EMPTY", 12, None)],
                         "building_id bigint, building_name string, total_floors int, address string")
    return conform(b.unionByName(extra), "buildings")


def units(spark: SparkSession, nation: DataFrame) -> DataFrame:
    u = nation.select(
        F.col("n_nationkey").cast("bigint").alias("unit_id"),
        F.col("n_regionkey").cast("bigint").alias("building_id"),
        F.col("n_name").alias("unit_number"),
        F.lit(12).alias("floors"),
    )
    extra = literal_rows(spark, [(999, 0, "NO ROOMS", 6)],
                         "unit_id bigint, building_id bigint, unit_number string, floors int")
    return conform(u.unionByName(extra), "units")


def rooms(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return conform(customer.select(
        k.alias("room_id"),
        F.col("c_nationkey").cast("bigint").alias("unit_id"),
        F.col("c_name").alias("room_number"),
        (F.lit(40) + (k % 9000) * F.lit(Decimal("0.01"))).cast("decimal(10,2)").alias("area"),
        _case(F.col("c_mktsegment"), {"BUILDING": "商铺", "FURNITURE": "储藏室"}, "住宅").alias("room_type"),
        F.when(k % 7 == 6, "空置").when(k % 11 == 10, "装修中").otherwise("已入住").alias("status"),
    ), "rooms")


def residents(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return conform(customer.select(
        k.alias("resident_id"),
        F.when(k % 7 == 6, k - 1).otherwise(k).alias("room_id"),
        F.col("c_name").alias("name"),
        F.when(k % 2 == 0, "男").otherwise("女").alias("gender"),
        (F.lit(13800000000) + k).cast("string").alias("phone"),
        (F.lit(110101190000000000) + k).cast("string").alias("id_card"),
        F.when(k % 7 == 6, "家属").when(k % 5 == 4, "租客").otherwise("业主").alias("relationship"),
        F.date_add(F.lit("2015-01-01").cast("date"), (k % 3000).cast("int")).alias("move_in_date"),
    ), "residents")


def parking_spaces(part: DataFrame) -> DataFrame:
    size = F.col("p_size")
    return conform(part.select(
        F.col("p_partkey").alias("space_id"),
        F.concat(F.col("p_brand"), F.lit("-"), F.col("p_partkey").cast("string")).alias("space_number"),
        F.col("p_brand").alias("area_name"),
        F.when(F.col("p_type").isin("LARGE", "PROMO"), "大型")
         .when(F.col("p_type") == "ECONOMY", "充电").otherwise("普通").alias("space_type"),
        F.when(size <= 20, "空闲").when(size <= 40, "已租").when(size <= 47, "已售")
         .otherwise("维修中").alias("status"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("monthly_price"),
    ), "parking_spaces")


def vehicles(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return conform(customer.select(
        k.alias("vehicle_id"),
        k.alias("resident_id"),
        F.when(k % 6 == 0, F.lit(None)).otherwise(k - k % 4).alias("space_id"),
        F.concat(F.lit("P"), k.cast("string")).alias("plate_no"),
        _case(k % 8, {0: "轿车", 2: "SUV", 4: "电动车"}, "摩托车").alias("vehicle_type"),
    ), "vehicles")


# fixed values: the fee categories of the fixture (five seed categories plus one by usage)
FEE_CATEGORY_NAMES = {1: "物业管理费", 2: "停车管理费", 3: "垃圾处理费", 4: "公共维修基金", 5: "电梯维护费", 6: "水费"}


def fee_categories(part: DataFrame) -> DataFrame:
    """One category per residue of the part key (bills use the same rule), priced from its cheapest part."""
    cheapest = part.groupBy((F.lit(1) + F.col("p_partkey") % 6).alias("category_id")).agg(
        F.min(F.col("p_retailprice").cast("decimal(10,2)")).alias("p"))
    k = F.col("category_id")
    return conform(cheapest.select(
        "category_id",
        _case(k, FEE_CATEGORY_NAMES, None).alias("category_name"),
        F.when(k == 6, "季").otherwise("月").alias("billing_cycle"),
        F.when(k.isin(1, 4), "按面积").when(k == 6, "按用量").otherwise("固定").alias("calc_method"),
        (F.col("p") * F.lit(Decimal("0.0125"))).cast("decimal(10,4)").alias("unit_price"),
    ), "fee_categories")


ROWS_A_TASK = 200_000            # lines that one task joins and groups, about
MOST_ROWS_A_TASK = 1_200_000     # and at most, where more tasks would cost the scan more memory


def tasks_for(rows: int, rows_a_task: int) -> int:
    """How many tasks ``rows`` are dealt to, so that a task's share does not grow with the table."""
    return max(1, -(-rows // rows_a_task))


def tasks_for_lines(spark: SparkSession, rows: int) -> int:
    """How many tasks ``rows`` lines are dealt to.

    Up to ``spark.shuffle.sort.bypassMergeThreshold`` tasks a scan writes a line as it reads it; for more, Spark's
    sorting writer holds what one split deals (about 1 GB of 128 MB).  So there are no more while a share is bearable.
    """
    few = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(min(tasks_for(rows, ROWS_A_TASK), few), tasks_for(rows, MOST_ROWS_A_TASK))


def fee_records(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One bill per order and line number (equal pairs are summed), so ``fee_id`` is unique at any size.

    Both tables are dealt out by order key, to as many tasks as the lines ask for (their count is read from
    the Parquet footers): a task sorts its share for the join and for the grouping, which reuses the dealing,
    and the session's number of shuffle partitions does not bound that share.
    """
    n = tasks_for_lines(lineitem.sparkSession, lineitem.count())
    li = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag",
                         "l_linestatus", "l_shipdate").where("l_orderkey is not null").repartition(n, "l_orderkey")
    od = orders.select("o_orderkey", "o_custkey").where("o_orderkey is not null").repartition(n, "o_orderkey")
    x = li.join(od, li.l_orderkey == od.o_orderkey, "inner").groupBy("l_orderkey", "l_linenumber", "o_custkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(10,2)")).alias("l_extendedprice"),
        *[F.min(c).alias(c) for c in ("l_partkey", "l_returnflag", "l_linestatus", "l_shipdate")])
    x = x.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fee_id"),
        F.col("o_custkey").alias("resident_id"),
        (F.lit(1) + F.col("l_partkey") % 6).alias("category_id"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("amount"),
        F.date_format("l_shipdate", "yyyy-MM").alias("fee_period"),
        F.when((F.col("l_linestatus") == "F") & F.col("l_returnflag").isin("N", "A"), "已缴")
         .when(F.col("l_linestatus") == "F", "逾期")
         .when(F.col("l_returnflag") == "R", "部分缴纳")
         .otherwise("待缴").alias("status"),
        F.col("l_shipdate"),
    )
    st = F.col("status")
    return conform(x.select(
        "fee_id", "resident_id", "category_id", "amount",
        F.when(st == "已缴", F.col("amount"))
         .when(st == "部分缴纳", F.col("amount") * F.lit(Decimal("0.5")))
         .otherwise(F.lit(0)).cast("decimal(10,2)").alias("paid_amount"),
        "fee_period", "status",
        F.concat(F.col("fee_period"), F.lit("-25")).cast("date").alias("due_date"),
        F.when(st == "已缴", F.col("l_shipdate").cast("date")).alias("paid_date"),
        F.col("l_shipdate").alias("created_at"),
    ), "fee_records")


def staff(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    return conform(supplier.select(
        k.alias("staff_id"),
        F.col("s_name").alias("name"),
        F.when(k % 2 == 0, "男").otherwise("女").alias("gender"),
        (F.lit(13900000000) + k).cast("string").alias("phone"),
        _case(k % 4, {0: "维修工", 1: "保安", 2: "保洁"}, "经理").alias("role"),
        F.abs(F.col("s_acctbal")).cast("decimal(10,2)").alias("salary"),
        F.date_add(F.lit("2010-01-01").cast("date"), (k % 1000).cast("int")).alias("hire_date"),
        F.when(k % 10 == 9, "离职").otherwise("在职").alias("status"),
    ), "staff")


def repair_orders(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    cancelled = k % 13 == 12
    return conform(orders.select(
        k.alias("order_id"),
        F.col("o_custkey").alias("resident_id"),
        F.when(k % 4 == 3, F.lit(None)).otherwise(k % 10).alias("staff_id"),
        F.concat(F.lit("R"), k.cast("string")).alias("title"),
        _case(F.col("o_orderpriority"), {"1-URGENT": "紧急", "2-HIGH": "高", "5-LOW": "低"}, "中").alias("priority"),
        F.when(cancelled, "已取消").when(F.col("o_orderstatus") == "F", "已完成")
         .when(F.col("o_orderstatus") == "O", "待处理").otherwise("处理中").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(~cancelled & (F.col("o_orderstatus") == "F"),
               F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("completed_at"),
    ), "repair_orders")


def complaints(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return conform(events.filter(F.col("event_type").isin("error", "purchase")).select(
        k.alias("complaint_id"),
        F.col("user_id").alias("resident_id"),
        F.concat(F.lit("C"), k.cast("string")).alias("title"),
        F.col("props").alias("content"),
        _case(k % 3, {0: "投诉", 1: "建议"}, "咨询").alias("complaint_type"),
        _case(k % 4, {0: "待处理", 1: "处理中", 2: "已解决"}, "已关闭").alias("status"),
        F.col("ts").alias("created_at"),
    ), "complaints")


def announcements(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return conform(events.filter(F.col("event_type") == "signup").select(
        k.alias("announcement_id"),
        F.concat(F.lit("A"), k.cast("string")).alias("title"),
        F.col("props").alias("content"),
        _case(k % 4, {0: "通知", 1: "公告", 2: "活动"}, "紧急").alias("ann_type"),
        F.lit("office").alias("publisher"),
        (k % 17 == 0).alias("is_top"),
        F.col("ts").alias("created_at"),
    ), "announcements")


def visitor_records(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    return conform(events.filter(F.col("event_type").isin("view", "click")).select(
        k.alias("visitor_id"),
        F.col("user_id").alias("resident_id"),
        F.concat(F.lit("V"), k.cast("string")).alias("visitor_name"),
        _case(k % 6, {0: "探访", 1: "快递", 2: "外卖", 3: "维修", 4: "商务"}, "其他").alias("purpose"),
        F.col("ts").alias("entry_time"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("ts") + F.expr("INTERVAL 45 MINUTES")).alias("exit_time"),
    ), "visitor_records")


class LazyTables(Mapping):
    """A read-only table mapping whose entries are built on first use and then reused.

    ``rows()``: about how many rows all tables have, ``rows_of(name)``: how many one has at most, to size shuffles
    by (None: not known)."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]], rows: Callable[[], int | None] = lambda: None,
                 rows_of: Callable[[str], int | None] = lambda name: None):
        self._builders = builders
        self._built: dict[str, DataFrame] = {}
        self.rows, self.rows_of = rows, rows_of

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


# The table whose rows an estate table is made of (not the fee categories: these are few).
SOURCES = {"buildings": "region", "units": "nation", "rooms": "customer", "residents": "customer", "vehicles": "customer",
           "parking_spaces": "part", "staff": "supplier", "repair_orders": "orders", "fee_records": "lineitem",
           "complaints": "events", "announcements": "events", "visitor_records": "events"}


def derive_estate(spark: SparkSession, base: Mapping[str, DataFrame]) -> LazyTables:
    """All thirteen estate tables from the provided base tables.

    Lazy twice over: a table is only planned when a job asks for it, and
    nothing but the counts that shuffles are sized by (from the Parquet
    footers) runs until the job's result is written.
    """
    def rows() -> int:
        # residents, rooms and vehicles come from the customers; the other tables have one source each
        return sum((3 if n == "customer" else 1) * base[n].count() for n in BASE_TABLES)

    return LazyTables({
        "buildings": lambda: buildings(spark, base["region"]),
        "units": lambda: units(spark, base["nation"]),
        "rooms": lambda: rooms(base["customer"]),
        "residents": lambda: residents(base["customer"]),
        "parking_spaces": lambda: parking_spaces(base["part"]),
        "vehicles": lambda: vehicles(base["customer"]),
        "fee_categories": lambda: fee_categories(base["part"]),
        "fee_records": lambda: fee_records(base["lineitem"], base["orders"]),
        "staff": lambda: staff(base["supplier"]),
        "repair_orders": lambda: repair_orders(base["orders"]),
        "complaints": lambda: complaints(base["events"]),
        "announcements": lambda: announcements(base["events"]),
        "visitor_records": lambda: visitor_records(base["events"]),
    }, rows, lambda name: base[SOURCES[name]].count() if name in SOURCES else None)
