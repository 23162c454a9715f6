"""One way in for a change batch: rules, the table's own effects, and what they set off in other tables.

The graph below says what a change sets off (SURVEY §2.10, T1-T6):

* *row effects* belong to the changed rows themselves: a new bill is priced, a paid one gets its status, a completed
  order or solved complaint its stamp;
* *follow-on effects* are change batches for other tables: who moves in occupies the room, who resigns
  returns the open orders.  They go through the same dispatch, so their own effects run as well.

A follow-on batch is a join of the change's keys with the table it touches; nothing is looked at row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from . import billing, changes

Tables = Mapping[str, DataFrame]


@dataclass
class Applied:
    """``tables``: every table the batch touched, as it is afterwards; ``rejected``: refused rows with ``reasons``."""

    tables: dict[str, DataFrame]
    rejected: DataFrame
    trail: list[str] = field(default_factory=list)          # "table op" in the order they were applied


def _paid(t: Tables, batch: DataFrame, as_of) -> DataFrame:
    """T2 on the bills the batch changes: their status and paid date follow the amounts."""
    new = changes.apply_updates(t["fee_records"], batch, "fee_records")
    marked = changes._hit(new, "fee_id", batch.select("fee_id"), "__touched")
    kept = marked.select("*", F.col("status").alias("__status"), F.col("paid_date").alias("__paid_date"))
    ruled = billing.payment_status(kept, as_of)
    return ruled.select(*[F.when(F.col("__touched"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c)
                          if c in ("status", "paid_date") else F.col(c) for c in new.columns])


def _moved_in(t: Tables, rows: DataFrame, as_of) -> list[tuple[str, DataFrame]]:
    rooms = rows.select("room_id").distinct().withColumn("status", F.lit(S.OCCUPIED))
    return [("rooms", rooms)]


def _resigned(t: Tables, batch: DataFrame, as_of) -> list[tuple[str, DataFrame]]:
    if "status" not in batch.columns:
        return []
    gone = changes.resigned_staff(t["staff"], batch)
    orders = t["repair_orders"].where(F.col("status").isin(S.ORDER_PENDING, S.ORDER_ACTIVE))
    mine = orders.join(gone, F.col("staff_id") == F.col("resigned_id"), "left_semi")
    return [("repair_orders", mine.select("order_id", F.lit(None).cast("bigint").alias("staff_id"), F.lit(S.ORDER_PENDING).alias("status")))]


#: (table, op) -> the table after the batch, where it is more than the batch's values.
ROW_EFFECTS: dict[tuple[str, str], Callable[[Tables, DataFrame, object], DataFrame]] = {
    ("repair_orders", "update"): lambda t, b, as_of: changes.repair_completion(t["repair_orders"], b, as_of),
    ("complaints", "update"): lambda t, b, as_of: changes.complaint_resolution(t["complaints"], b, as_of),
    ("fee_records", "update"): _paid,
}
#: (table, op) -> the batch as it is inserted.
PREPARE: dict[tuple[str, str], Callable[[Tables, DataFrame], DataFrame]] = {
    ("fee_records", "insert"): lambda t, b: billing.bill_amounts(b, t),
}
#: (table, op) -> the update batches it sets off, from the tables before it and its accepted rows.
FOLLOW_ON: dict[tuple[str, str], Callable[[Tables, DataFrame, object], list[tuple[str, DataFrame]]]] = {
    ("residents", "insert"): _moved_in,
    ("staff", "update"): _resigned,
}


def apply_changes(t: Tables, table: str, batch: DataFrame, op: str = "update", as_of=None, trusted: bool = False) -> Applied:
    """Apply an ``insert`` or ``update`` batch to ``table`` with all it sets off.

    Steps of one key (by ``seq``) are taken in order: a step that breaks a row rule or a reference is refused by
    itself; uniqueness is looked at after the whole batch, and a key refused there keeps none of its steps.
    ``trusted`` batches (what effects set off) are not checked again.  A change of an unknown key does nothing.
    """
    if op not in ("insert", "update"):
        raise ValueError(f"no dispatch for {op}")
    spec = S.TABLES[table]
    trail = [f"{table} {op}"]
    if op == "insert":
        ready = PREPARE.get((table, op), lambda t, b: b)(t, batch)
        out = changes.validated_inserts(t, ready, table, as_of)
        accepted, rejected, after = out["accepted"], out["rejected"], out["table"]
    else:
        accepted, rejected = (batch, None) if trusted else changes.valid_steps(t, batch, table)
        plain = ROW_EFFECTS.get((table, op)) or (lambda t, b, as_of: changes.apply_updates(t[table], b, table))
        after = plain(t, accepted, as_of)
    tables = {table: after}
    for other, follow in FOLLOW_ON.get((table, op), lambda *a: [])(t, accepted, as_of):
        then = apply_changes(dict(t) | tables, other, follow, "update", as_of, trusted=True)
        tables |= then.tables
        trail += then.trail
    if rejected is None:
        none = F.array().cast("array<string>")
        rejected = batch.select(spec.key, none.alias("reasons")).limit(0)
    return Applied(tables, rejected, trail)


def apply_all(t: Tables, batches: list[tuple[str, str, DataFrame]], as_of=None) -> Applied:
    """Several batches (table, op, rows) one after the other; ``rejected`` carries the table's name and the key."""
    now, touched, rejected, trail = dict(t), {}, [], []
    for table, op, batch in batches:
        a = apply_changes(now, table, batch, op, as_of)
        now |= a.tables
        touched |= a.tables
        trail += a.trail
        rejected.append(a.rejected.select(F.lit(table).alias("table_name"), F.col(S.TABLES[table].key).cast("bigint").alias("row_key"),
                                          F.col("reasons").cast("array<string>").alias("reasons")))
    return Applied(touched, reduce(DataFrame.unionByName, rejected), trail)
