"""Named queries: key → job over the estate tables, plus the oracle SQL of each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from . import schemas as S
from .operators import billing as B
from .operators import changelog as L
from .operators import changes as M
from .operators import dispatch as D
from .operators import integrity as I
from .operators import integrity_delta as V
from .operators import reports as R
from .sources import batches as X
from .sources.dirty import dirty_estate
from .sources.parquet import load_estate

Job = Callable[[dict], DataFrame]

REPORT_JOBS: dict[str, Job] = {
    "dashboard": R.dashboard,
    "latest_announcements": R.latest_announcements,
    "community_summary": R.community_summary,
    "table_counts": R.table_counts,
    "building_rollup": R.building_rollup,
    "unit_rollup": R.unit_rollup,
    "room_list": R.room_list,
    "vacant_rooms": R.vacant_rooms,
    "resident_list": R.resident_list,
    "resident_overview": R.resident_overview,
    "resident_unpaid": R.resident_unpaid,
    "resident_recent_repairs": R.resident_recent_repairs,
    "parking_list": R.parking_list,
    "parking_overview": R.parking_overview,
    "parking_by_area": R.parking_by_area,
    "vehicle_list": R.vehicle_list,
    "fee_list": R.fee_list,
    "fee_periods": R.fee_periods,
    "fee_report": R.fee_report,
    "fee_category_list": R.fee_category_list,
    "repair_board": R.repair_board,
    "open_repairs": R.open_repairs,
    "repair_detail": R.repair_detail,
    "complaint_board": R.complaint_board,
    "open_complaints": R.open_complaints,
    "announcement_board": R.announcement_board,
    "visitor_log": R.visitor_log,
    "staff_list": R.staff_list,
    "active_repairers": R.active_repairers,
}


AS_OF = X.AS_OF

WRITE_JOBS: dict[str, Job] = {
    "bill_amounts": lambda t: B.bill_amounts(X.new_bills(t), t),
    "generate_bills": lambda t: B.generate_bills(t, X.PERIODS, AS_OF),
    "payment_status": lambda t: B.payment_status(
        t["fee_records"].select("fee_id", "amount", "paid_amount", "status", "paid_date"), AS_OF),
    "post_payments": lambda t: B.post_payments(t["fee_records"], X.payments(t)),
    "ledger_after_payments": lambda t: B.ledger_after_payments(
        t["fee_records"], X.payments(t), t["fee_categories"], AS_OF),
    "repair_completion": lambda t: M.repair_completion(t["repair_orders"], X.repair_changes(t), AS_OF),
    "complaint_resolution": lambda t: M.complaint_resolution(t["complaints"], X.complaint_changes(t), AS_OF),
    "room_occupancy": lambda t: M.room_occupancy(
        t["rooms"], M.validated_inserts(t, X.new_residents(t), "residents", AS_OF)["accepted"]),
    "staff_resignation": lambda t: M.staff_resignation(t["staff"], X.staff_changes(t),
                                                       t["repair_orders"])["repair_orders"],
    "apply_inserts": lambda t: M.validated_inserts(t, X.new_residents(t), "residents", AS_OF)["table"],
    "apply_updates": lambda t: M.apply_updates(t["vehicles"], X.vehicle_changes(t), "vehicles"),
    "visit_exit": lambda t: M.visit_exit(t["visitor_records"], X.open_visits(t), AS_OF),
    "repair_assignment": lambda t: M.repair_assignment(t["repair_orders"], X.repair_assignments(t)),
    "set_null_on_delete": lambda t: M.set_null_on_delete(t["vehicles"], "space_id", X.spaces_in_repair(t)),
    "cascade_delete": lambda t: M.deleted_counts(t, "buildings", X.unaddressed_buildings(t)),
    "insert_rejects": lambda t: M.insert_reasons(t, X.new_residents(t), "residents", AS_OF).select(
        "resident_id", F.explode("reasons").alias("reason")),
    "staff_after_resignation": lambda t: M.staff_resignation(t["staff"], X.staff_changes(t), t["repair_orders"])["staff"],
    "cascade_survivors_residents": lambda t: M.cascade_delete(t, "buildings", X.unaddressed_buildings(t))["residents"],
    "cascade_survivors_vehicles": lambda t: M.cascade_delete(t, "buildings", X.unaddressed_buildings(t))["vehicles"],
    "cascade_survivors_fee_records": lambda t: M.cascade_delete(t, "buildings", X.unaddressed_buildings(t))["fee_records"],
    "fee_list_period": lambda t: R.fee_list(t, X.PERIODS[0]),
    "fee_report_period": lambda t: R.fee_report(t, X.PERIODS[0]),
    "update_rejects": lambda t: M.update_reasons(t, X.resident_changes(t), "residents").select(
        "resident_id", F.explode("reasons").alias("reason")),
    "residents_after_updates": lambda t: M.validated_updates(t, X.resident_changes(t), "residents")["table"],
    "dispatch_repair_orders": lambda t: D.apply_changes(t, "repair_orders", X.repair_changes(t), as_of=AS_OF).tables["repair_orders"],
    "dispatch_complaints": lambda t: D.apply_changes(t, "complaints", X.complaint_changes(t), as_of=AS_OF).tables["complaints"],
    "dispatch_rooms": lambda t: D.apply_changes(t, "residents", X.new_residents(t), "insert", AS_OF).tables["rooms"],
    "dispatch_orders_of_staff": lambda t: D.apply_changes(t, "staff", X.staff_changes(t), as_of=AS_OF).tables["repair_orders"],
    "dispatch_fee_records": lambda t: D.apply_changes(t, "fee_records", X.fee_changes(t), as_of=AS_OF).tables["fee_records"],
    "apply_log": lambda t: L.apply_log(t, X.session_log(t), AS_OF, {"vehicles"})["vehicles"],
    "apply_log_rejects": lambda t: L.apply_log(t, X.session_log(t), AS_OF, set())["rejected"],
    "foreign_key_usage": R.foreign_key_usage,
    "staff_json": R.staff_json,
    "sample_unpaid_bill": R.sample_unpaid_bill,
    "sample_open_order": R.sample_open_order,
    "visitor_times": R.visitor_times,
    **{f"cascade_survivors_{n}": lambda t, n=n: M.cascade_delete(t, "buildings", X.unaddressed_buildings(t))[n]
       for n in ("buildings", "units", "rooms", "repair_orders", "complaints", "visitor_records")},
    "repair_detail_open": lambda t: R.repair_detail(t, X.repair_assignments(t).select("order_id")),
}


def _after(rule: str, t) -> DataFrame:
    """The rule's listing brought up to date by the inserted rows alone."""
    counts = V.state(rule, t)
    if rule == "bills":
        batches = {"fee_records": (X.repeated_bills(t), None)}
    else:
        new = M.fill_defaults(X.new_residents(t), "residents", AS_OF)
        batches = {"residents": (new.unionByName(X.repeated_residents(t)), None)}
    return V.violations_after(counts, V.violations(counts), batches)


INTEGRITY_JOBS: dict[str, Job] = {
    "pk_duplicates": lambda t: I.pk_duplicates(dirty_estate(t)),
    "unique_violations": lambda t: I.unique_violations(dirty_estate(t)),
    "fk_orphans": lambda t: I.fk_orphans(dirty_estate(t)),
    "null_violations": lambda t: I.null_violations(dirty_estate(t)),
    "check_violations": lambda t: I.check_violations(dirty_estate(t)),
    "enum_violations": lambda t: I.enum_violations(dirty_estate(t)),
    "length_violations": lambda t: I.length_violations(dirty_estate(t)),
    "duplicate_bills": I.duplicate_bills,
    "pk_duplicates_after": lambda t: _after("pk", t),
    "unique_violations_after": lambda t: _after("unique", t),
    "duplicate_bills_after": lambda t: _after("bills", t),
}


def jobs() -> dict[str, Job]:
    out = dict(REPORT_JOBS)
    out.update(WRITE_JOBS)
    out.update(INTEGRITY_JOBS)
    return out


def sql_bodies() -> dict:
    out = dict(oracles.REPORTS)
    out.update(oracles.WRITES)
    out.update(oracles.INTEGRITY)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(job: Job):
        return lambda spark, sf_dir: job(load_estate(spark, sf_dir))
    return {k: bind(j) for k, j in jobs().items()}


def oracle_sql() -> dict[str, str]:
    return {k: oracles.with_estate(v) if isinstance(v, str) else oracles.with_estate(*v)
            for k, v in sql_bodies().items()}
