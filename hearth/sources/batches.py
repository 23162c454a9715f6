"""Change batches derived from the estate tables (FIXTURES.md §2, whole-table form).

Each batch is a projection of a whole table, so the change jobs it feeds
touch every row and their work grows with the data.  The DuckDB oracle
builds the same batches with the same formulas (:mod:`hearth.oracles`).
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

AS_OF = "2002-01-01 00:00:00"          # fixed clock of every comparison
PERIODS = ["1998-03", "2030-01", "2030-13"]   # one with bills, one without, one malformed
NEW_ID_OFFSET = 10_000_000_000          # ids of inserted residents: beyond any existing key


def payments(t) -> DataFrame:
    """1 to 5 payments on every bill; the pattern rotates: 0, 40 %, 70 %, 60 % of what is owed, 1."""
    fr = t["fee_records"].select("fee_id", "amount", "paid_amount")
    x = fr.select("fee_id", "amount", "paid_amount",
                  F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(1) + F.col("fee_id") % 5)).alias("k"))
    rest = F.col("amount") - F.col("paid_amount")
    j = (F.col("fee_id") + F.col("k")) % 5
    amt = (F.when(j == 0, F.lit(0)).when(j == 1, rest * Decimal("0.4")).when(j == 2, rest * Decimal("0.7"))
            .when(j == 3, rest * Decimal("0.6")).otherwise(F.lit(1)))
    return x.select("fee_id", F.col("k").cast("int").alias("seq"), amt.cast("decimal(10,2)").alias("pay_amount"))


def new_bills(t) -> DataFrame:
    """Every resident × every category for 2030-01: amount 0 (to be priced) for even residents, else 12.34."""
    res = t["residents"].select("resident_id")
    cats = t["fee_categories"].select("category_id")
    pairs = res.crossJoin(cats)          # the batch is every pair; the catalogue is a few rows
    return pairs.select(
        "resident_id", "category_id",
        F.when(F.col("resident_id") % 2 == 0, F.lit(0)).otherwise(F.lit(Decimal("12.34")))
         .cast("decimal(10,2)").alias("amount"),
        F.lit("2030-01").alias("fee_period"), F.lit("2030-01-25").cast("date").alias("due_date"))


def repair_changes(t) -> DataFrame:
    """A status for every order: a ninth completed, a ninth in progress, a ninth reopened, the rest as they are."""
    k = F.col("order_id") % 9
    return t["repair_orders"].select(
        "order_id", F.when(k == 0, "已完成").when(k == 1, "处理中").when(k == 2, "待处理")
                     .otherwise(F.col("status")).alias("status"))


def complaint_changes(t) -> DataFrame:
    """Status and reply for every complaint: a third resolved (with a reply), a third in progress."""
    k = F.col("complaint_id") % 3
    return t["complaints"].select(
        "complaint_id", F.when(k == 1, "已解决").when(k == 2, "处理中").otherwise(F.col("status")).alias("status"),
        F.when(k == 1, F.lit("done")).alias("reply"))


def new_residents(t) -> DataFrame:
    """A new resident for every resident, moved to the vacant room of its block of seven rooms.

    Some rows break rules on purpose (for the insert validation): every 13th has a gender
    outside the domain, every 17th keeps the id card of the resident it copies, and
    every 19th takes the one of the next new resident (the first of the two is accepted).
    """
    r = t["residents"]
    k = F.col("resident_id")
    return r.select(
        (k + NEW_ID_OFFSET).alias("resident_id"),
        (F.col("room_id") - F.col("room_id") % 7 + 6).alias("room_id"),
        "name", F.when(k % 13 == 0, F.lit("未知")).otherwise(F.col("gender")).alias("gender"), "phone",
        F.when(k % 17 == 0, F.col("id_card"))
         .when(k % 19 == 0, (F.col("id_card").cast("decimal(20,0)") + (NEW_ID_OFFSET + 1)).cast("string"))
         .otherwise((F.col("id_card").cast("decimal(20,0)") + NEW_ID_OFFSET).cast("string")).alias("id_card"),
        F.when(F.col("resident_id") % 3 == 0, F.lit(None)).otherwise(F.col("relationship")).alias("relationship"),
        "move_in_date")


def staff_changes(t) -> DataFrame:
    """A status for every staff member: every fifth leaves (some have left already)."""
    return t["staff"].select(
        "staff_id", F.when(F.col("staff_id") % 5 == 4, "离职").otherwise(F.col("status")).alias("status"))


def open_visits(t) -> DataFrame:
    """Key set: the visits still open (everyone inside leaves)."""
    return t["visitor_records"].filter(F.col("exit_time").isNull()).select("visitor_id")


def vehicle_changes(t) -> DataFrame:
    """A colour and type for every vehicle (space_id absent from the batch, so it is kept)."""
    k = F.col("vehicle_id") % 3
    return t["vehicles"].select(
        "vehicle_id", F.when(k == 0, "黑").when(k == 1, "白").otherwise(F.lit(None)).alias("color"),
        F.when(k == 2, "电动车").otherwise(F.col("vehicle_type")).alias("vehicle_type"))


def repair_assignments(t) -> DataFrame:
    """Every open order gets a repairer, or is unassigned where order_id % 3 = 0."""
    o = t["repair_orders"].filter(F.col("status").isin("待处理", "处理中"))
    return o.select("order_id", F.when(F.col("order_id") % 3 == 0, F.lit(None))
                    .otherwise((F.col("order_id") % 10 + 1) * 4).cast("bigint").alias("staff_id"))


def unaddressed_buildings(t) -> DataFrame:
    """Key set: buildings without an address (deleted with everything below them)."""
    return t["buildings"].filter(F.col("address").isNull()).select("building_id")


def spaces_in_repair(t) -> DataFrame:
    """Key set: parking spaces under maintenance (deleted; vehicles on them lose the space)."""
    return t["parking_spaces"].filter(F.col("status") == "维修中").select("space_id")


def resident_changes(t) -> DataFrame:
    """New values for every resident, in groups of eleven by key: two swap their id cards, three pass theirs on in
    a chain (which breaks where its end has a gender outside the domain), one wants the card of a neighbour who
    keeps it, two want the same new card; some rooms do not exist."""
    k = F.col("resident_id")
    j = k % 11
    card = lambda n: (F.lit(Decimal("110101190000000000")) + n).cast("decimal(20,0)").cast("string")      # noqa: E731
    return t["residents"].select(
        "resident_id", F.when(k % 17 == 3, F.col("room_id") + NEW_ID_OFFSET).otherwise(F.col("room_id")).alias("room_id"),
        F.when(k % 13 == 5, F.lit("未知")).otherwise(F.col("gender")).alias("gender"),
        (F.lit(13900000000) + k).cast("string").alias("phone"),
        F.when(j.isin(0, 3, 4, 7), card(k + 1)).when(j == 1, card(k - 1)).when(j == 5, card(k + NEW_ID_OFFSET))
         .when(j.isin(9, 10), card(k - j + NEW_ID_OFFSET)).otherwise(F.col("id_card")).alias("id_card"))


def fee_changes(t) -> DataFrame:
    """A paid amount for every bill: all of it, half of it, or what it was."""
    k = F.col("fee_id") % 3
    return t["fee_records"].select(
        "fee_id", F.when(k == 0, F.col("amount")).when(k == 1, F.col("amount") * Decimal("0.5")).otherwise(F.col("paid_amount"))
        .cast("decimal(10,2)").alias("paid_amount"))


def session_log(t) -> dict[str, DataFrame]:
    """One session's changes to residents, spaces and vehicles, in order of ``seq`` over all three tables.

    Residents leave (their vehicles go with them) and some return; spaces under maintenance go (vehicles
    lose them); vehicles change owner, space and colour, go and come back, some against the rules."""
    r, s, v = t["residents"], t["parking_spaces"], t["vehicles"]
    k = F.col("resident_id")

    def step(df, cond, seq, op, **values):
        return df.where(cond).select(F.lit(seq).cast("bigint").alias("seq"), F.lit(op).alias("op"),
                                     *[e.alias(n) for n, e in values.items()])

    res = [c for c in S.TABLES["residents"].names if c != "created_at"]
    residents = [step(r, k % 6 == 1, 100, "D", **{c: F.col(c) for c in res}),
                 step(r, k % 12 == 1, 200, "I", **{c: F.col(c) if c != "name" else F.lit("back") for c in res}),
                 step(r, k % 24 == 1, 300, "D", **{c: F.col(c) for c in res})]
    spaces = step(s, F.col("status") == "维修中", 150, "D", space_id=F.col("space_id"))
    n = F.col("vehicle_id")

    def car(cond, seq, op, fields=None, **new):
        base = {c: F.col(c) for c in ("vehicle_id", "resident_id", "space_id", "plate_no", "vehicle_type", "color")}
        names = F.lit(None).cast("array<string>") if fields is None else F.array(*[F.lit(f) for f in fields])
        return step(v, cond, seq, op, **(base | new), fields=names)

    vehicles = [
        car(n % 4 == 0, 50, "U", ["color"], color=F.lit("红")),
        car(n % 3 == 0, 120, "U", ["resident_id"], resident_id=n + 1),
        car(n % 10 == 7, 130, "D"),
        car(n % 10 == 7, 140, "I", color=F.lit("新"), space_id=F.lit(None).cast("bigint")),
        car(n % 10 == 3, 160, "I", color=F.lit("拒")),
        car(n % 5 == 0, 170, "U", ["space_id"], space_id=n),
        car(n % 12 == 1, 250, "I", color=F.lit("回")),
        car(n % 2 == 1, 260, "U", ["color"], color=F.lit("末"))]
    return {"residents": reduce(DataFrame.unionByName, residents), "parking_spaces": spaces,
            "vehicles": reduce(DataFrame.unionByName, vehicles)}


def repeated_residents(t) -> DataFrame:
    """Every ninth resident once more, whole (same key, same id card)."""
    return t["residents"].where(F.col("resident_id") % 9 == 0)


def repeated_bills(t) -> DataFrame:
    """Every fifth bill once more under a new key."""
    b = t["fee_records"].where(F.col("fee_id") % 5 == 0)
    return b.withColumn("fee_id", F.col("fee_id") + NEW_ID_OFFSET)
