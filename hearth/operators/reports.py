"""Read-side reports: dashboards, listings, rollups, overviews.

Every function takes ``t`` — a dict of the estate tables as DataFrames — and
returns a DataFrame; nothing is collected.  Large child tables are
aggregated to one row per key *before* they meet their parent, so fan-out
never reaches a shuffle, and partial aggregation absorbs hot keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..functions import count_if, display_date, display_time, full_address, or_default, percent_text, value_rank
from ..plans.address import attach_room_place, attach_unit_place, resident_places
from ..plans.scalars import combine_scalars, counts


def _keys(df: DataFrame, key: str, keys) -> DataFrame:
    """Restrict ``df`` to a key set given as a DataFrame (semi join) or an iterable (isin)."""
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        k = keys.select(F.col(keys.columns[0]).alias("__k")).distinct()
        return df.join(k, df[key] == k["__k"], "left_semi")
    return df.filter(F.col(key).isin(list(keys)))


# ----------------------------------------------------------------------------- dashboard

def _count_if(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"   # NULL over no rows, as in SQL


def dashboard(t) -> DataFrame:
    """One row of headline counts (the console page)."""
    def among(*v):
        return "status IN (" + ", ".join(f"'{x}'" for x in v) + ")"
    return combine_scalars([
        counts(t["buildings"], buildings="count(*)"),
        counts(t["rooms"], rooms_total="count(*)", rooms_occupied=_count_if(among(S.OCCUPIED))),
        counts(t["residents"], residents="count(*)"),
        counts(t["parking_spaces"], parking_total="count(*)", parking_available=_count_if(among(S.SPACE_FREE))),
        counts(t["repair_orders"], repairs_total="count(*)",
               repairs_pending=_count_if(among(S.ORDER_PENDING, S.ORDER_ACTIVE))),
        counts(t["complaints"], complaints_total="count(*)",
               complaints_pending=_count_if(among(S.COMPLAINT_PENDING))),
        counts(t["fee_records"], fees_total="count(*)", fees_unpaid=_count_if(among(S.FEE_UNPAID, S.FEE_OVERDUE))),
    ])


def latest_announcements(t, n: int = 5) -> DataFrame:
    """Top ``n``: pinned first, then newest; id breaks ties so the choice is fixed."""
    return t["announcements"].orderBy(F.col("is_top").desc(), F.col("created_at").desc(),
                                      F.col("announcement_id").desc()).limit(n)


def community_summary(t) -> DataFrame:
    """One row with the size of seven tables."""
    names = ["buildings", "units", "rooms", "residents", "parking_spaces", "vehicles", "staff"]
    return combine_scalars([counts(t[n], **{n: "count(*)"}) for n in names])


def table_counts(t) -> DataFrame:
    """(table_name, row_count) for every estate table."""
    parts = [counts(t[n], row_count="count(*)").selectExpr(f"'{n}' AS table_name", "row_count")
             for n in S.TABLE_ORDER if n in t]
    return reduce(DataFrame.unionByName, parts)


# ----------------------------------------------------------------------------- structure

def _rooms_per_unit(t) -> DataFrame:
    # room_id is the key of rooms, so a count per unit equals COUNT(DISTINCT room_id); partial
    # aggregation keeps a unit with a third of all rooms from landing whole in one task.
    return t["rooms"].groupBy(F.col("unit_id").alias("rc_unit_id")).agg(F.count("room_id").alias("rc"))


def building_rollup(t) -> DataFrame:
    """Buildings with their number of units and rooms; empty buildings give 0."""
    b = t["buildings"]
    per_unit = (t["units"].select("unit_id", F.col("building_id").alias("u_building_id"))
                .join(_rooms_per_unit(t), F.col("unit_id") == F.col("rc_unit_id"), "left"))
    per_building = per_unit.groupBy("u_building_id").agg(
        F.count("unit_id").alias("unit_count"), F.sum(F.coalesce("rc", F.lit(0))).alias("room_count"))
    return (b.join(per_building, b.building_id == per_building.u_building_id, "left")
             .select(*[b[c] for c in b.columns],
                     F.coalesce("unit_count", F.lit(0)).cast("bigint").alias("unit_count"),
                     F.coalesce("room_count", F.lit(0)).cast("bigint").alias("room_count"))
             .orderBy("building_id"))


def unit_rollup(t) -> DataFrame:
    """Units with their building's name and number of rooms."""
    u = t["units"]
    b = t["buildings"].select(F.col("building_id").alias("b_building_id"), "building_name")
    return (u.join(b, u.building_id == b.b_building_id, "inner")
             .join(_rooms_per_unit(t), u.unit_id == F.col("rc_unit_id"), "left")
             .select(*[u[c] for c in u.columns], "building_name",
                     F.coalesce("rc", F.lit(0)).cast("bigint").alias("room_count"))
             .orderBy("building_id", "unit_number", "unit_id"))


def room_list(t) -> DataFrame:
    """Rooms with building, unit and full address."""
    r = t["rooms"]
    return (attach_unit_place(t, r, "unit_id")
            .withColumn("full_address", full_address("building_name", "unit_number", "room_number"))
            .orderBy("place_building_id", "unit_id", "room_number", "room_id")
            .select(*[r[c] for c in r.columns], "building_name", "unit_number", "full_address"))


def vacant_rooms(t) -> DataFrame:
    """The room list narrowed to vacant rooms (filter reaches the rooms scan)."""
    return room_list(t).filter(F.col("status") == S.VACANT)


def resident_list(t) -> DataFrame:
    """Residents with room number, area and address."""
    res = t["residents"]
    return (attach_room_place(t, res, "room_id")
            .orderBy("place_building_id", "unit_number", "room_number", "resident_id")
            .select(*[res[c] for c in res.columns], "room_number", "area", "building_name", "unit_number",
                    "full_address"))


# ----------------------------------------------------------------------------- residents

def child_counts(t, children: dict[str, str]) -> DataFrame:
    """resident_id → one count column per child table, from ONE shuffle.

    The children's resident keys are unioned with a tag and counted together;
    each map task pre-aggregates, so a resident owning a third of all rows
    costs one partial row per task, not a third of the data in one task.
    """
    tagged = reduce(DataFrame.unionByName, [
        t[tab].select(F.col("resident_id").alias("cc_resident_id"), F.lit(out).alias("cc_kind"))
        for tab, out in children.items()])
    return tagged.groupBy("cc_resident_id").agg(
        *[count_if(F.col("cc_kind") == out).alias(out) for out in children.values()])


def resident_overview(t, residents=None) -> DataFrame:
    """Per resident: profile, address and how many vehicles, repairs and complaints."""
    res = _keys(t["residents"], "resident_id", residents)
    kids = {"vehicles": "vehicle_count", "repair_orders": "repair_count", "complaints": "complaint_count"}
    counts = child_counts(t, kids)
    return (attach_room_place(t, res, "room_id")
               .join(counts, F.col("resident_id") == counts.cc_resident_id, "left")
               .select("resident_id", "name", "gender", "phone", "id_card", "relationship", "move_in_date",
                       "room_number", "area", "room_type", "full_address",
                       *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in kids.values()]))


def resident_unpaid(t, residents=None) -> DataFrame:
    """Per resident, bills not fully paid (``部分缴纳`` included) with what remains, by due date."""
    fr = _keys(t["fee_records"], "resident_id", residents).filter(F.col("status") != S.FEE_PAID)
    fc = t["fee_categories"].select(F.col("category_id").alias("c_category_id"), "category_name")
    return (fr.join(fc, fr.category_id == fc.c_category_id, "inner")
              .select("fee_id", "resident_id", "category_name", "amount", "paid_amount",
                      (F.col("amount") - F.col("paid_amount")).cast("decimal(10,2)").alias("remaining"),
                      "fee_period", "due_date")
              .orderBy("resident_id", "due_date", "fee_id"))


def resident_recent_repairs(t, n: int = 5, residents=None) -> DataFrame:
    """Latest ``n`` repair orders of every resident.

    ``row_number() <= n`` lets Spark insert a partial window-group limit
    before the shuffle, so each map task forwards at most ``n`` rows per
    resident, and a resident with millions of orders stays cheap.
    """
    ro = _keys(t["repair_orders"], "resident_id", residents)
    w = Window.partitionBy("resident_id").orderBy(F.col("created_at").desc(), F.col("order_id").desc())
    return (ro.select("resident_id", "order_id", "title", "priority", "status", "created_at",
                      F.row_number().over(w).alias("recent_rank"))
              .filter(F.col("recent_rank") <= n)
              .withColumn("recent_rank", F.col("recent_rank").cast("bigint")))


# ----------------------------------------------------------------------------- parking

def parking_list(t) -> DataFrame:
    """Spaces with the vehicles on them and their owners (two vehicles on a space → two rows).

    Written as (spaces ⋈ vehicles) ∪ (spaces without vehicles) rather than a left
    join: AQE can split a skewed partition on either side of an inner join, but
    only the preserved side of a left join, so a space holding a third of all
    vehicles would otherwise land whole in one task.  The anti join sees only the
    *distinct* occupied space ids.
    """
    ps = t["parking_spaces"]
    v = (t["vehicles"].select(F.col("space_id").alias("v_space_id"), F.col("resident_id").alias("v_resident_id"),
                              "plate_no", "vehicle_type").filter(F.col("v_space_id").isNotNull()))
    res = t["residents"].select(F.col("resident_id").alias("r_resident_id"), F.col("name").alias("resident_name"))
    matched = (ps.join(v, ps.space_id == v.v_space_id, "inner")
                 .join(res, F.col("v_resident_id") == F.col("r_resident_id"), "left")
                 .select(*[ps[c] for c in ps.columns], "plate_no", "vehicle_type", "resident_name"))
    used = v.select("v_space_id").distinct()
    empty = ps.join(used, ps.space_id == used.v_space_id, "left_anti").select(
        *ps.columns, F.lit(None).cast("string").alias("plate_no"), F.lit(None).cast("string").alias("vehicle_type"),
        F.lit(None).cast("string").alias("resident_name"))
    return matched.unionByName(empty).orderBy("space_number", "space_id", "plate_no")


def parking_overview(t) -> DataFrame:
    st = F.col("status")
    return t["parking_spaces"].agg(
        F.count(F.lit(1)).alias("total_spaces"),
        count_if(st == S.SPACE_FREE).alias("available"),
        count_if(st == S.SPACE_RENTED).alias("rented"),
        count_if(st == S.SPACE_SOLD).alias("sold"),
        count_if(st == S.SPACE_REPAIR).alias("under_maintenance"),
        percent_text(count_if(st.isin(S.SPACE_RENTED, S.SPACE_SOLD)), F.count(F.lit(1))).alias("occupancy_rate"))


def parking_by_area(t) -> DataFrame:
    return t["parking_spaces"].groupBy("area_name").agg(
        F.count(F.lit(1)).alias("total"), count_if(F.col("status") == S.SPACE_FREE).alias("available"))


def vehicle_list(t) -> DataFrame:
    v = t["vehicles"]
    res = t["residents"].select(F.col("resident_id").alias("r_resident_id"), F.col("name").alias("resident_name"))
    ps = t["parking_spaces"].select(F.col("space_id").alias("p_space_id"), "space_number")
    return (v.join(res, v.resident_id == res.r_resident_id, "inner")
             .join(ps, v.space_id == ps.p_space_id, "left")
             .orderBy("vehicle_id")
             .select(*[v[c] for c in v.columns], "resident_name", "space_number"))


# ----------------------------------------------------------------------------- fees

def fee_list(t, period: str | None = None) -> DataFrame:
    """Bills with category, resident, address, remaining and whether payable; optional period."""
    fr = t["fee_records"]
    if period:                     # empty or missing period: no filter
        fr = fr.filter(F.col("fee_period") == period)
    fc = t["fee_categories"].select(F.col("category_id").alias("c_category_id"), "category_name")
    who = resident_places(t).drop("resident_phone")
    return (fr.join(fc, fr.category_id == fc.c_category_id, "inner").join(
                who, fr.resident_id == who.p_resident_id, "inner")
              .orderBy(F.col("fee_period").desc(), F.col("resident_name").asc(), F.col("fee_id"))
              .select(*[fr[c] for c in fr.columns], "category_name", "resident_name", "full_address",
                      (F.col("amount") - F.col("paid_amount")).cast("decimal(10,2)").alias("remaining"),
                      (F.col("status") != S.FEE_PAID).alias("payable")))


def fee_periods(t) -> DataFrame:
    return t["fee_records"].select("fee_period").distinct().orderBy(F.col("fee_period").desc())


def fee_report(t, period: str | None = None) -> DataFrame:
    """Per period and category: bills, amounts, paid/overdue counts and payment rate.

    Bills are aggregated on (period, category_id) first — a partial
    aggregate per map task — and only the small result meets the category
    names, so the fee table is shuffled once, already reduced.
    """
    fr = t["fee_records"]
    if period:
        fr = fr.filter(F.col("fee_period") == period)
    st = F.col("status")
    agg = fr.groupBy("fee_period", F.col("category_id").alias("a_category_id")).agg(
        F.count("fee_id").alias("total_bills"),
        F.sum("amount").cast("decimal(20,2)").alias("total_amount"),
        F.sum("paid_amount").cast("decimal(20,2)").alias("total_paid"),
        F.sum(F.col("amount") - F.col("paid_amount")).cast("decimal(20,2)").alias("total_unpaid"),
        count_if(st == S.FEE_PAID).alias("paid_count"),
        count_if(st == S.FEE_OVERDUE).alias("overdue_count"))
    fc = t["fee_categories"].select("category_id", "category_name")
    return (agg.join(fc, agg.a_category_id == fc.category_id, "inner")
               .select("fee_period", "category_id", "category_name", "total_bills", "total_amount", "total_paid",
                       "total_unpaid", "paid_count", "overdue_count",
                       percent_text("paid_count", "total_bills").alias("payment_rate"))
               .orderBy(F.col("fee_period").desc(), F.col("total_amount").desc(), "category_id"))


def fee_category_list(t) -> DataFrame:
    return t["fee_categories"].orderBy("category_id")


# ----------------------------------------------------------------------------- repairs, complaints

def repair_board(t) -> DataFrame:
    """Orders with resident, staff and address; open work first (status_rank), newest first."""
    ro = t["repair_orders"]
    who = resident_places(t)
    s = t["staff"].select(F.col("staff_id").alias("s_staff_id"), F.col("name").alias("staff_name"))
    return (ro.join(who, ro.resident_id == who.p_resident_id, "inner")
              .join(s, ro.staff_id == s.s_staff_id, "left")
              .select(*[ro[c] for c in ro.columns], "resident_name", "resident_phone", "staff_name",
                      "full_address", value_rank(ro.status, S.REPAIR_STATUS).alias("status_rank"))
              .orderBy("status_rank", F.col("created_at").desc(), "order_id"))


def open_repairs(t) -> DataFrame:
    return repair_board(t).filter(~F.col("status").isin(S.ORDER_DONE, S.ORDER_CANCELLED))


def repair_detail(t, orders=None) -> DataFrame:
    """Full detail of the given orders (all orders when no key set is given)."""
    ro = _keys(t["repair_orders"], "order_id", orders)
    who = resident_places(t)
    s = t["staff"].select(F.col("staff_id").alias("s_staff_id"), F.col("name").alias("staff_name"),
                          F.col("phone").alias("staff_phone"))
    return (ro.join(who, ro.resident_id == who.p_resident_id, "inner")
              .join(s, ro.staff_id == s.s_staff_id, "left")
              .select("order_id", "title", "description", "location", "priority", "status", "created_at",
                      "completed_at", "resident_name", "resident_phone", "full_address", "staff_name",
                      "staff_phone"))


def complaint_board(t) -> DataFrame:
    c = t["complaints"]
    res = t["residents"].select(F.col("resident_id").alias("r_resident_id"), F.col("name").alias("resident_name"),
                                F.col("phone").alias("resident_phone"))
    return (c.join(res, c.resident_id == res.r_resident_id, "inner")
             .select(*[c[x] for x in c.columns], "resident_name", "resident_phone",
                     value_rank(c.status, S.COMPLAINT_STATUS).alias("status_rank"))
             .orderBy("status_rank", F.col("created_at").desc(), "complaint_id"))


def open_complaints(t) -> DataFrame:
    return complaint_board(t).filter(~F.col("status").isin(S.COMPLAINT_SOLVED, S.COMPLAINT_CLOSED))


# ----------------------------------------------------------------------------- notices, visits, staff

def announcement_board(t) -> DataFrame:
    return t["announcements"].orderBy(F.col("is_top").desc(), F.col("created_at").desc(), "announcement_id")


def visitor_log(t) -> DataFrame:
    """Visits with resident and address, newest first; ``is_open`` = not yet left."""
    v = t["visitor_records"]
    who = resident_places(t).drop("resident_phone")
    return (v.join(who, v.resident_id == who.p_resident_id, "inner")
             .select(*[v[c] for c in v.columns], "resident_name", "full_address",
                     F.col("exit_time").isNull().alias("is_open"))
             .orderBy(F.col("entry_time").desc(), "visitor_id"))


def staff_list(t) -> DataFrame:
    """Staff in the declared order of their status (an ENUM sorts by declaration), then id."""
    s = t["staff"]
    return (s.select(*s.columns, value_rank("status", S.STAFF_STATUS).alias("status_rank"))
             .orderBy("status_rank", "staff_id"))


def active_repairers(t) -> DataFrame:
    return t["staff"].filter((F.col("role") == S.REPAIRER) & (F.col("status") == S.STAFF_ACTIVE))


# ----------------------------------------------------------------------------- multi-result calls

def resident_overview_sets(t, residents=None, n_recent: int = 5) -> dict[str, DataFrame]:
    """The three result sets of the per-resident overview, each under its own name."""
    return {"info": resident_overview(t, residents), "unpaid_fees": resident_unpaid(t, residents),
            "recent_repairs": resident_recent_repairs(t, n_recent, residents)}


def parking_statistics(t) -> dict[str, DataFrame]:
    """The two result sets of the parking statistics: one overview row and the per-area counts."""
    return {"overview": parking_overview(t), "by_area": parking_by_area(t)}


def foreign_keys(spark) -> DataFrame:
    """The declared references as data (child table, column, parent table, parent key, on delete) — S7."""
    rows = [(n, r.column, r.parent, r.parent_key, r.on_delete.upper())
            for n, spec in S.TABLES.items() for r in spec.refs]
    return spark.createDataFrame(rows, "table_name string, column_name string, referenced_table string, "
                                       "referenced_column string, on_delete string")


def foreign_key_usage(t) -> DataFrame:
    """Every declared reference (S7) with what points along it: rows with a reference and rows without one."""
    parts = []
    for name, spec in S.TABLES.items():
        if spec.refs:
            counts = t[name].agg(*[F.count(r.column).alias(f"c{i}") for i, r in enumerate(spec.refs)], F.count(F.lit(1)).alias("n"))
            parts.append(counts.select(F.inline(F.array(*[F.struct(
                F.lit(name).alias("table_name"), F.lit(r.column).alias("column_name"), F.lit(r.parent).alias("referenced_table"),
                F.lit(r.parent_key).alias("referenced_column"), F.lit(r.on_delete.upper()).alias("on_delete"),
                F.col(f"c{i}").alias("referencing_rows"), (F.col("n") - F.col(f"c{i}")).alias("empty_rows"))
                for i, r in enumerate(spec.refs)]))))
    return reduce(DataFrame.unionByName, parts)


def staff_json(t) -> DataFrame:
    """The staff list as JSON texts (S4): one per person, ISO dates, exact decimals, nulls and Chinese text kept."""
    shown = ("staff_id", "name", "gender", "phone", "role", "salary", "hire_date", "status", "created_at")
    return t["staff"].select("staff_id", F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("json"))


def any_row(df: DataFrame, key: str) -> DataFrame:
    """Any one row (O8): the one with the smallest key, so that the answer is fixed.  One partial row a task, no sort."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).agg(F.min(F.struct(key, *rest)).alias("r")).where("r is not null").select(
        *[F.col(f"r.{c}").alias(c) for c in df.columns])


def sample_unpaid_bill(t) -> DataFrame:
    """One bill still to be paid, to try a payment on."""
    bills = t["fee_records"].where(F.col("status") == S.FEE_UNPAID)
    return any_row(bills.select("fee_id", "amount", "paid_amount", "status"), "fee_id")


def sample_open_order(t) -> DataFrame:
    """One order not completed, to try a completion on."""
    orders = t["repair_orders"].where(F.col("status") != S.ORDER_DONE)
    return any_row(orders.select("order_id", "status", "completed_at"), "order_id")


def visitor_times(t) -> DataFrame:
    """The visits' times as displayed (F11, P17): who has not left yet is shown as 未离开, no remark as a dash."""
    return t["visitor_records"].select(
        "visitor_id", display_time("entry_time").alias("entry_text"), display_time("exit_time", "未离开").alias("exit_text"),
        display_date("entry_time").alias("entry_day"), or_default("remark", "-").alias("remark_text"))


def keys_of(df: DataFrame, column: str) -> DataFrame:
    """A one-column key set, for the optional ``residents=`` / ``orders=`` arguments."""
    return df.select(column).distinct()
