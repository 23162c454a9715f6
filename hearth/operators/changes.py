"""Change application as batch jobs: snapshot + change batch → new snapshot.

Per-row writes and their trigger side effects become set operations over a
whole batch: the batch is joined to the current snapshot on the key once
(one shuffle of each side, or a broadcast when AQE measures the batch
small), and every follow-on effect is a ``when`` over the joined row.
Plain Parquet has no row update, so results are new snapshots.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..plans.lineage import cut_lineage
from .conflicts import accepted_in_order, passed_on


def as_of_col(as_of) -> Column:
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(as_of, Column):
        return as_of
    ts = as_of if isinstance(as_of, datetime) else datetime.fromisoformat(str(as_of))
    # a text literal cast to timestamp_ntz carries no time zone, whatever the session's zone is
    return F.lit(ts.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def _key_set(keys, name: str = "__key") -> DataFrame | list:
    if isinstance(keys, DataFrame):
        return keys.select(F.col(keys.columns[0]).alias(name)).distinct()
    return list(keys)


def _hit(df: DataFrame, key: str, keys, flag: str) -> DataFrame:
    """``df`` plus a boolean ``flag``: is the row's key in ``keys`` (DataFrame or list)."""
    ks = _key_set(keys, "__hit_key")
    if isinstance(ks, list):
        return df.withColumn(flag, F.coalesce(F.col(key).isin(ks), F.lit(False)))
    ks = ks.withColumn(flag, F.lit(True))
    return (df.join(ks, df[key] == ks["__hit_key"], "left").drop("__hit_key")
              .withColumn(flag, F.coalesce(F.col(flag), F.lit(False))))


def _order(changes: DataFrame, key: str) -> Column:
    """Order of a key's changes: ``seq`` (null first) where the batch has one, then the status, then the other values,
    so equal or missing sequence numbers still give the same winner on every run."""
    first = F.col("seq") if "seq" in changes.columns else F.lit(0)
    return F.struct(first.alias("__seq"), *[F.col(c) for c in _values(changes, key)])


def _values(changes: DataFrame, key: str) -> list[str]:
    rest = [c for c in changes.columns if c not in (key, "seq")]
    return sorted(rest, key=lambda c: c != "status")             # status first, the others as they come


def latest_changes(changes: DataFrame, key: str) -> DataFrame:
    """One change per key, the last one by :func:`_order` (requests applied in order).

    ``max`` is a partial aggregate, so a key with a great many changes in
    one batch is reduced on the map side before it is shuffled.
    """
    cols = [c for c in changes.columns if c not in (key, "seq")]
    last = changes.groupBy(key).agg(F.max(_order(changes, key)).alias("__last"))
    return last.select(key, *[F.col(f"__last.{c}").alias(c) for c in cols])


#: Into so many ranges of ``seq`` a batch is cut at most; no range of one key holds more than its share of the batch.
RANGES = 1024


def _steps(changes: DataFrame, key: str, status_to: str, left: Callable[[Column], Column]) -> DataFrame:
    """One row per key: its last change (``__last``), the first step's status (``__first``) and whether a
    later step of the batch enters ``status_to`` from a status that satisfies ``left`` (``__later``).

    Steps with equal key, ``seq`` and status make one (no status changes between them), before the shuffle.  A key's
    steps are then summarised by ranges of ``seq`` — quantiles of the whole batch, so a key that holds a third of
    it is cut into a third of the ranges — as (first, last, entered), and these summaries, at most ``RANGES`` a key,
    are put together in order: entering also happens between one range's last status and the next one's first.
    """
    cols = _values(changes, key)
    if "seq" not in changes.columns:
        # in the order of the statuses only the one before ``status_to`` can be left for it: plain aggregates
        before = F.max(F.when(F.col("status") < status_to, F.col("status")))
        x = changes.groupBy(key).agg(
            F.max(F.struct(*cols)).alias("__last"), F.min(F.struct("status")).alias("__f"), before.alias("__before"),
            F.max(F.coalesce(F.col("status") == status_to, F.lit(False))).alias("__has"))
        return x.select(key, "__last", F.col("__f.status").alias("__first"),
                        (F.col("__has") & F.coalesce(left(F.col("__before")), F.lit(False))).alias("__later"))
    seq = F.col("seq")
    x = changes.groupBy(key, seq.alias("__seq"), "status").agg(F.max(F.struct(*cols)).alias("__v"))
    at = F.struct("__seq", "status")

    def entered(w: Window) -> Column:
        prev = F.lag("status").over(w)
        return F.coalesce((F.col("__n") > 1) & (F.col("status") == status_to) & left(prev), F.lit(False))

    n = min(RANGES, int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = changes.agg(F.percentile_approx(seq.cast("double"), [k / n for k in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    # F.lit of a list is one literal array; the range is the number of cuts below the step's seq (null: the first)
    x = x.withColumn("__r", F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c < F.col("__seq")))
                     if cuts else F.lit(0))
    x = x.withColumn("__r", F.when(F.col("__seq").isNull(), -1).otherwise(F.col("__r")))
    w = Window.partitionBy(key, "__r").orderBy(at)
    x = x.withColumn("__n", F.row_number().over(w)).withColumn("__in", entered(w))
    x = x.groupBy(key, "__r").agg(
        F.min(at).alias("__a"), F.max(F.struct("__seq", "status", "__v")).alias("__z"), F.max("__in").alias("__in"))
    w = Window.partitionBy(key).orderBy("__r")
    first = F.col("__a.status")
    between = F.coalesce((first == status_to) & left(F.lag("__z.status").over(w)), F.lit(False))
    x = x.withColumn("__n", F.row_number().over(w)).withColumn("__in", F.col("__in") | ((F.col("__n") > 1) & between))
    last, status = F.struct("__z.__seq", F.col("__z.__v")), first
    return x.groupBy(key).agg(
        F.max(last).alias("__m"), F.max(F.when(F.col("__n") == 1, status)).alias("__first"),
        F.max("__in").alias("__later")).select(key, F.col("__m.__v").alias("__last"), "__first", "__later")


def apply_updates(current: DataFrame, changes: DataFrame, table: str) -> DataFrame:
    """M2: overwrite, by key, the columns the change batch carries.

    A column present in the batch wins even when its value is null; a column
    absent from the batch is kept; a change for an unknown key does nothing.
    Of several changes for one key the last by ``seq`` wins (without one, the largest by value).
    """
    key = S.TABLES[table].key
    changes = latest_changes(changes, key)
    cols = [c for c in changes.columns if c != key and c in current.columns]
    ch = changes.select(F.col(key).alias("__ck"), *[F.col(c).alias(f"__new_{c}") for c in cols])
    j = current.join(ch, current[key] == ch["__ck"], "left")
    hit = F.col("__ck").isNotNull()
    return j.select(*[F.when(hit, F.col(f"__new_{c}")).otherwise(current[c]).alias(c) if c in cols else current[c]
                      for c in current.columns])


def _stamp_on_entry(current: DataFrame, changes: DataFrame, table: str, status_to: str, stamp_col: str,
                    as_of) -> DataFrame:
    """Update by key; stamp ``stamp_col`` when the status *enters* ``status_to`` from another value.

    Every step of a key's changes counts (enter, leave and enter again stamps once, as the
    per-request trigger would).  The snapshot is read once: the status before the first step is
    on the joined row.
    """
    key = S.TABLES[table].key
    if "status" not in changes.columns:
        return apply_updates(current, changes, table)
    cols = [c for c in changes.columns if c not in (key, "seq") and c in current.columns]
    steps = _steps(changes, key, status_to, lambda prev: prev != status_to).withColumnRenamed(key, "__ck")
    j = current.join(steps, current[key] == steps["__ck"], "left")
    hit = F.col("__ck").isNotNull()
    became = F.col("__later") | ((F.col("__first") == status_to) & (current["status"] != status_to))
    new = {c: F.when(hit, F.col(f"__last.{c}")).otherwise(current[c]) for c in cols}
    new[stamp_col] = F.when(became, as_of_col(as_of)).otherwise(new.get(stamp_col, current[stamp_col]))
    return j.select(*[new.get(c, current[c]).alias(c) for c in current.columns])


def repair_completion(current: DataFrame, changes: DataFrame, as_of=None) -> DataFrame:
    """Orders after a change batch; becoming 已完成 from another status stamps completed_at.

    Reopening does not clear the stamp; inserted orders are not stamped.
    """
    return _stamp_on_entry(current, changes, "repair_orders", S.ORDER_DONE, "completed_at", as_of)


def complaint_resolution(current: DataFrame, changes: DataFrame, as_of=None) -> DataFrame:
    """T4: complaints after a change batch; becoming 已解决 stamps resolved_at."""
    return _stamp_on_entry(current, changes, "complaints", S.COMPLAINT_SOLVED, "resolved_at", as_of)


def room_occupancy(rooms: DataFrame, new_residents: DataFrame) -> DataFrame:
    """T5: a newly inserted resident's room becomes 已入住 (moves by update and departures do not touch rooms)."""
    moved_in = new_residents.select(F.col("room_id").alias("__mi")).distinct()
    j = _hit(rooms, "room_id", moved_in, "__in")
    return j.select(*[F.when(F.col("__in"), F.lit(S.OCCUPIED)).otherwise(F.col("status")).alias("status")
                      if c == "status" else F.col(c) for c in rooms.columns])


def resigned_staff(staff: DataFrame, staff_changes: DataFrame) -> DataFrame:
    """Keys of staff whose status goes 在职 → 离职 in some step of the batch."""
    steps = _steps(staff_changes, "staff_id", S.STAFF_LEFT, lambda prev: prev == S.STAFF_ACTIVE)
    steps = steps.withColumnRenamed("staff_id", "resigned_id")
    now = (F.col("__first") == S.STAFF_LEFT) & (F.col("status") == S.STAFF_ACTIVE)
    return (staff.select("staff_id", "status").join(steps, F.col("staff_id") == F.col("resigned_id"), "inner")
                 .filter(F.col("__later") | now).select("resigned_id"))


def staff_resignation(staff: DataFrame, staff_changes: DataFrame, orders: DataFrame) -> dict[str, DataFrame]:
    """Staff after the batch, and orders after it — a resigned person's open orders
    (待处理/处理中) lose their staff and return to 待处理."""
    gone = resigned_staff(staff, staff_changes)
    j = _hit(orders, "staff_id", gone, "__gone")
    reset = F.col("__gone") & F.col("status").isin(S.ORDER_PENDING, S.ORDER_ACTIVE)
    new_orders = j.select(*[
        F.when(reset, F.lit(None).cast("bigint")).otherwise(F.col(c)).alias(c) if c == "staff_id"
        else F.when(reset, F.lit(S.ORDER_PENDING)).otherwise(F.col(c)).alias(c) if c == "status"
        else F.col(c) for c in orders.columns])
    return {"staff": apply_updates(staff, staff_changes, "staff"), "repair_orders": new_orders}


def repair_assignment(orders: DataFrame, assignments: DataFrame) -> DataFrame:
    """M6: (order_id, staff_id) batch; a person assigned → 处理中, no one → 待处理."""
    ch = assignments.select("order_id", "staff_id",
                            F.when(F.col("staff_id").isNotNull(), F.lit(S.ORDER_ACTIVE))
                             .otherwise(F.lit(S.ORDER_PENDING)).alias("status"))
    return apply_updates(orders, ch, "repair_orders")


def visit_exit(visits: DataFrame, keys, as_of=None) -> DataFrame:
    """M3: exit_time = as_of for the given visits (an earlier exit is overwritten)."""
    j = _hit(visits, "visitor_id", keys, "__left")
    return j.select(*[F.when(F.col("__left"), as_of_col(as_of)).otherwise(F.col(c)).alias(c) if c == "exit_time"
                      else F.col(c) for c in visits.columns])


def fill_defaults(batch: DataFrame, table: str, as_of=None, keep: tuple[Column, ...] = ()) -> DataFrame:
    """The batch in the table's schema (and ``keep``), declared defaults filled where a column is absent or null."""
    spec = S.TABLES[table]
    have = set(batch.columns)
    cols = []
    for c in spec.columns:
        v = F.col(c.name) if c.name in have else F.lit(None)
        if c.default_now:
            v = F.coalesce(v, as_of_col(as_of))
        elif c.default is not None:
            v = F.coalesce(v, F.lit(c.default))
        cols.append(v.cast(S.spark_type(c.dtype)).alias(c.name))
    return batch.select(*cols, *keep)


def apply_inserts(current: DataFrame, batch: DataFrame, table: str, as_of=None) -> DataFrame:
    """M1: append a batch, filling declared defaults for absent or null columns (ids come with the batch)."""
    return current.select(*S.TABLES[table].names).unionByName(fill_defaults(batch, table, as_of))


def rule_findings(spec: S.Table, carried: set[str] | None = None) -> list[Column]:
    """The row rules (NOT NULL, enum, length, CHECK) of the ``carried`` columns (default: all): a finding's text or null each."""
    out = []
    for c in spec.columns:
        if carried is not None and c.name not in carried:
            continue
        col = F.col(c.name)
        if not c.nullable:
            out.append(F.when(col.isNull(), F.lit(f"NULL:{c.name}")))
        if c.domain:
            out.append(F.when(~col.isin(list(c.domain)), F.lit(f"ENUM:{c.name}")))
        if c.length is not None:
            out.append(F.when(F.char_length(col) > c.length, F.lit(f"LENGTH:{c.name}")))
    for rule, cond in spec.checks:
        if carried is None or any(re.search(rf"\b{c}\b", cond) for c in carried):
            out.append(F.when(~F.expr(cond), F.lit(f"CHECK:{rule}")))
    return out


def insert_reasons(t, batch: DataFrame, table: str, as_of=None) -> DataFrame:
    """Every batch row (defaults filled) with ``reasons``: the rules of §2.11 the insert would break.

    Rows are taken in order of ``seq`` (where the batch has one) and key, as single requests would be:
    of rows that break no other rule and share a key, the first is inserted and the rest are refused.
    Row rules (NOT NULL, enum, CHECK, length) are column expressions; key, unique and reference
    rules each look up the batch's own values in the current tables; all findings of a row
    meet in one aggregate.
    """
    from .integrity import COLLATION
    spec = S.TABLES[table]
    seq = (F.col("seq") if "seq" in batch.columns else F.lit(0)).alias("__seq")
    rows = fill_defaults(batch, table, as_of, (seq,)).withColumn("__rid", F.monotonically_increasing_id())
    rows = cut_lineage(rows)                         # pin the row ids before the checks fan out
    checks = rule_findings(spec)

    def key_columns(df: DataFrame, cols, label: str, i: int) -> list[Column]:
        return [(F.collate(df[c], COLLATION) if spec.column(c).dtype == "string" and label != "PK" else df[c])
                .alias(f"__k{i}_{j}") for j, c in enumerate(cols)]

    found = []
    for r in spec.refs:
        mine = rows.select("__rid", F.col(r.column).alias("__p")).dropna(subset=["__p"])
        parent = t[r.parent].select(F.col(r.parent_key).alias("__p")).join(mine.select("__p"), "__p", "left_semi")
        found.append(mine.join(parent, "__p", "left_anti").select("__rid", F.lit(f"FK:{r.column}").alias("__why")))
    keysets = [((spec.key,), "PK")] + [(u, "UNIQUE:" + ",".join(u)) for u in spec.uniques]
    names = []
    for i, (cols, label) in enumerate(keysets):
        on = [f"__k{i}_{j}" for j in range(len(cols))]
        names.append((on, label))
        rows = rows.select("*", *key_columns(rows, cols, label, i))
        mine = rows.select("__rid", *on).dropna(subset=on)        # NULL key parts never collide (SQL UNIQUE)
        taken = t[table].select(*key_columns(t[table], cols, label, i)).join(mine.select(*on), on, "left_semi")
        found.append(mine.join(taken, on, "left_semi").select("__rid", F.lit(label).alias("__why")))
    own = F.filter(F.array(*checks), lambda x: x.isNotNull())
    whys = reduce(DataFrame.unionByName, found).groupBy("__rid").agg(F.collect_set("__why").alias("__found"))
    none = F.array().cast("array<string>")
    rows = cut_lineage(rows.join(whys, "__rid", "left").withColumn(
        "reasons", F.concat(own, F.coalesce("__found", none))).drop("__found"))
    valid = rows.filter(F.size("reasons") == 0).select(
        F.col("__rid").alias("rid"), F.struct("__seq", spec.key, "__rid").alias("o"), *[k for on, _ in names for k in on])
    late = accepted_in_order(valid, names)[0].groupBy(F.col("rid").alias("__rid")).agg(F.collect_set("why").alias("__late"))
    return rows.join(late, "__rid", "left").select(
        *spec.names, F.concat("reasons", F.coalesce("__late", none)).alias("reasons"))


def validated_inserts(t, batch: DataFrame, table: str, as_of=None) -> dict[str, DataFrame]:
    """M1 with validation: ``accepted`` rows (defaults filled), ``rejected`` rows with their reasons,
    and ``table`` = the current table plus the accepted rows."""
    checked = insert_reasons(t, batch, table, as_of)
    ok = checked.filter(F.size("reasons") == 0).drop("reasons")
    return {"accepted": ok, "rejected": checked.filter(F.size("reasons") > 0),
            "table": t[table].select(*S.TABLES[table].names).unionByName(ok)}


def _carried(batch: DataFrame, spec: S.Table) -> list[str]:
    return [c for c in _values(batch, spec.key) if c in spec.names]


def _step_reasons(t, rows: DataFrame, spec: S.Table, carried: list[str], rid: str) -> DataFrame:
    """``rows`` with ``reasons``: the row rules and references the carried columns break (one per row, named by ``rid``)."""
    own = F.filter(F.array(F.lit(None).cast("string"), *rule_findings(spec, set(carried))), lambda f: f.isNotNull())
    rows = cut_lineage(rows.withColumn("reasons", own))
    found = []
    for r in spec.refs:
        if r.column in carried:
            mine = rows.select(F.col(rid).alias("__id"), F.col(r.column).alias("__p")).dropna(subset=["__p"])
            parent = t[r.parent].select(F.col(r.parent_key).alias("__p"))
            found.append(mine.join(parent, "__p", "left_anti").select("__id", F.lit(f"FK:{r.column}").alias("__why")))
    if not found:
        return rows
    whys = reduce(DataFrame.unionByName, found).groupBy("__id").agg(F.collect_set("__why").alias("__found"))
    return (rows.join(whys, rows[rid] == whys["__id"], "left")
            .withColumn("reasons", F.concat("reasons", F.coalesce("__found", F.array().cast("array<string>")))).drop("__found", "__id"))


def _refused_keys(t, rows: DataFrame, spec: S.Table) -> DataFrame:
    """``id`` of the rows (changed ones, as they would be; ``__seq`` orders them, ``reasons`` empties a claim) whose unique
    key another row has or gets first.  A refused row gives up nothing."""
    from .integrity import COLLATION
    unique = spec.uniques[0]

    def collated(prefix: str) -> Column:
        """The unique key as one value, null where a part is."""
        cols = [F.col(f"{prefix}{c}") for c in unique]
        parts = [F.collate(x, COLLATION) if spec.column(c).dtype == "string" else x for c, x in zip(unique, cols, strict=True)]
        whole = reduce(lambda a, b: a & b, [x.isNotNull() for x in cols])
        return F.when(whole, F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]))

    movers = rows.where(F.size("reasons") == 0).select(
        F.col(spec.key).alias("id"), F.struct("__seq", spec.key).alias("o"), collated("__had_").alias("had"), collated("").alias("want"))
    movers = movers.where(~F.col("had").eqNullSafe(F.col("want"))).drop("had")
    holders = t[spec.name].select(collated("").alias("want"), F.col(spec.key).alias("holder")).where(F.col("want").isNotNull())
    return passed_on(movers, holders)[0]


def _changed(t, batch: DataFrame, spec: S.Table, carried: list[str]) -> DataFrame:
    """The table's rows that the batch names, as they would be after their last change, with ``__seq`` and the old
    unique key (``__had_``)."""
    key = spec.key
    last = batch.groupBy(F.col(key).alias("__ck")).agg(F.max(_order(batch, key)).alias("__last"))
    cur = t[spec.name].select(*spec.names)
    new = {c: F.col(f"__last.{c}").cast(S.spark_type(spec.column(c).dtype)) for c in carried}
    j = cur.join(last, cur[key] == last["__ck"])
    return j.select(*[new.get(c, cur[c]).alias(c) for c in spec.names], F.col("__last.__seq").alias("__seq"),
                    *[cur[c].alias(f"__had_{c}") for u in spec.uniques for c in u])


def _unique_of(spec: S.Table, carried: list[str]) -> bool:
    """Does the batch touch the table's unique rule?"""
    if len(spec.uniques) > 1:
        raise ValueError(f"{spec.name} has several unique rules")
    return bool(spec.uniques and set(spec.uniques[0]) & set(carried))


def update_reasons(t, batch: DataFrame, table: str) -> DataFrame:
    """Every row of ``table`` the batch names, as it would be after its change, with ``reasons``: the rules the change would break.

    The batch is taken as one set: of several changes of a key the last by ``seq`` counts, and uniqueness is looked at
    after the whole batch (deferred), so rows may pass their keys on and two rows may swap.  Of rows that want
    one unique key the first by ``seq`` and key gets it, if who holds it now gives it up by an accepted change; a refused
    change gives nothing up.  Row rules and references are checked for the columns the batch carries.  A change of an
    unknown or null key does nothing and is not listed.  Tables have at most one unique rule.
    """
    spec = S.TABLES[table]
    carried = _carried(batch, spec)
    rows = _step_reasons(t, _changed(t, batch, spec, carried), spec, carried, spec.key)
    if not _unique_of(spec, carried):
        return rows.select(*spec.names, "reasons")
    rows = cut_lineage(rows)
    lost = _refused_keys(t, rows, spec).select(F.col("id").alias("__lost"))
    late = F.when(F.col("__lost").isNotNull(), F.array(F.lit("UNIQUE:" + ",".join(spec.uniques[0])))).otherwise(
        F.array().cast("array<string>"))
    return (rows.join(lost, rows[spec.key] == lost["__lost"], "left")
            .select(*spec.names, F.concat("reasons", late).alias("reasons")))


def valid_steps(t, batch: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """The steps of an update batch that can be applied, and the refused ones with ``reasons``.

    A step that breaks a row rule or a reference is refused by itself; where the last values of what is left break the
    unique rule (see :func:`update_reasons`), all steps of that key are."""
    spec = S.TABLES[table]
    carried = _carried(batch, spec)
    named = batch.select(*[F.col(c).cast(S.spark_type(spec.column(c).dtype)).alias(c) if c in spec.names else F.col(c)
                           for c in batch.columns]).withColumn("__rid", F.monotonically_increasing_id())
    steps = cut_lineage(_step_reasons(t, cut_lineage(named), spec, carried, "__rid"))
    good = steps.where(F.size("reasons") == 0).select(*batch.columns)
    bad = steps.where(F.size("reasons") > 0).select(*batch.columns, "reasons")
    if not _unique_of(spec, carried):
        return good, bad
    rows = cut_lineage(_changed(t, good, spec, carried).withColumn("reasons", F.array().cast("array<string>")))
    lost = _refused_keys(t, rows, spec).select(F.col("id").alias("__lost"))
    kept = good.join(lost, good[spec.key] == lost["__lost"], "left_anti")
    late = good.join(lost, good[spec.key] == lost["__lost"], "left_semi").withColumn(
        "reasons", F.array(F.lit("UNIQUE:" + ",".join(spec.uniques[0]))))
    return kept, bad.unionByName(late)


def validated_updates(t, batch: DataFrame, table: str) -> dict[str, DataFrame]:
    """M2 with validation: ``accepted`` rows as they are after the change, ``rejected`` ones with reasons (as they would
    be), and ``table`` = the current table with the accepted rows in place."""
    spec = S.TABLES[table]
    checked = cut_lineage(update_reasons(t, batch, table))
    ok = checked.filter(F.size("reasons") == 0).drop("reasons")
    carried = [c for c in batch.columns if c in spec.names and c != spec.key]
    return {"accepted": ok, "rejected": checked.filter(F.size("reasons") > 0),
            "table": apply_updates(t[table].select(*spec.names), ok.select(spec.key, *carried), table)}


# ----------------------------------------------------------------------------- deletes

def delete_sets(t, table: str, keys, materialize: bool = True) -> dict[str, DataFrame]:
    """Key sets removed by deleting ``keys`` from ``table``, following every CASCADE edge top-down.

    Each child's set is a semi join of the child to its parent's set, so the
    chain building → unit → room → resident → children is a series of
    key-only joins; a set-null edge removes nothing and is handled by
    :func:`set_null_on_delete`.  With ``materialize`` every set that has
    children of its own is checkpointed once into the shared checkpoint
    folder, so the five children of ``residents`` do not each replan (and
    rescan) the whole chain above them, and a lost executor does not send
    the job back to the top.
    """
    spec = S.TABLES[table]
    start = _key_set(keys, "__key")
    if isinstance(start, list):
        start = t[table].filter(F.col(spec.key).isin(start)).select(F.col(spec.key).alias("__key"))
    else:
        start = t[table].join(start, F.col(spec.key) == start["__key"], "left_semi").select(
            F.col(spec.key).alias("__key"))
    out = {table: start}
    frontier = [table]
    while frontier:
        parent = frontier.pop(0)
        if materialize and any(r.on_delete == "cascade" for _, r in S.CHILDREN.get(parent, [])):
            out[parent] = cut_lineage(out[parent])
        for child, ref in S.CHILDREN.get(parent, []):
            if ref.on_delete != "cascade":
                continue
            ck = S.TABLES[child].key
            gone = (t[child].join(out[parent], F.col(ref.column) == out[parent]["__key"], "left_semi")
                            .select(F.col(ck).alias("__key")))
            out[child] = out[child].unionByName(gone).distinct() if child in out else gone
            frontier.append(child)
    return out


def cascade_delete(t, table: str, keys) -> dict[str, DataFrame]:
    """M4: every table after deleting ``keys`` from ``table`` with all cascades and set-nulls applied."""
    sets = delete_sets(t, table, keys)
    new = dict(t.items()) if hasattr(t, "items") else {n: t[n] for n in t}
    for name, gone in sets.items():
        k = S.TABLES[name].key
        new[name] = t[name].join(gone, F.col(k) == gone["__key"], "left_anti")
    for name, gone in sets.items():
        for child, ref in S.CHILDREN.get(name, []):
            if ref.on_delete == "set null":
                new[child] = set_null_on_delete(new[child], ref.column, gone)
    return new


def deleted_counts(t, table: str, keys) -> DataFrame:
    """(table_name, deleted_rows) for every table a delete reaches."""
    sets = delete_sets(t, table, keys)
    parts = [g.agg(F.count(F.lit(1)).alias("deleted_rows")).select(F.lit(n).alias("table_name"), "deleted_rows")
             for n, g in sets.items()]
    return reduce(DataFrame.unionByName, parts)


def set_null_on_delete(child: DataFrame, column: str, keys) -> DataFrame:
    """M5: null the reference ``column`` where it points at a deleted key."""
    j = _hit(child, column, keys, "__dead")
    dtype = dict(child.dtypes)[column]
    return j.select(*[F.when(F.col("__dead"), F.lit(None).cast(dtype)).otherwise(F.col(c)).alias(c) if c == column
                      else F.col(c) for c in child.columns])
