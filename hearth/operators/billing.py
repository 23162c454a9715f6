"""Billing and payments as batch jobs.

* ``bill_amounts`` prices new bills whose amount is 0 (B1).
* ``generate_bills`` makes a period's missing bills for every housed resident
  and every category, all periods of a batch at once (B2).
* ``post_payments`` applies a batch of payments in ``seq`` order per bill with
  a reason for every refusal (B3); ``ledger_after_payments`` is the bill table
  after it (B4); ``payment_status`` is the status rule on amounts (T2).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import due_date_of
from ..plans.ordinals import dense_ordinals
from ..session import ship_package
from .changes import as_of_col as _as_of
from .changes import fill_defaults
from .payment_chunks import Chunks, hot_bills

MONEY = "decimal(10,2)"

# fixed values: outcome of each payment
OK, UNKNOWN_FEE, ALREADY_PAID, NON_POSITIVE, OVERPAY = "OK", "UNKNOWN_FEE", "ALREADY_PAID", "NON_POSITIVE", "OVERPAY"


def price(calc_method: Column, unit_price: Column, area: Column, given: Column | None = None) -> Column:
    """Amount of a bill: by area → round(price × area, 2); fixed → price; by usage → the given amount.

    ``given`` (default 0) is kept when it is nonzero — hand-set amounts win.
    """
    given = F.lit(0).cast(MONEY) if given is None else given
    computed = (F.when(calc_method == S.BY_AREA, F.round(unit_price * area, 2))
                 .when(calc_method == S.FIXED, unit_price)
                 .otherwise(given))
    return F.when(given == 0, computed).otherwise(given).cast(MONEY)


def resident_areas(t) -> DataFrame:
    """resident_id → area of the resident's room (residents ⋈ rooms)."""
    res = t["residents"].select(F.col("resident_id").alias("ra_resident_id"), F.col("room_id").alias("ra_room_id"))
    r = t["rooms"].select(F.col("room_id").alias("ra_rid"), F.col("area").alias("ra_area"))
    return res.join(r, F.col("ra_room_id") == F.col("ra_rid"), "inner").select("ra_resident_id", "ra_area")


def bill_amounts(new_bills: DataFrame, t) -> DataFrame:
    """B1: price the bills of a batch whose amount is 0 from category and room area.

    A category that is missing leaves the amount as given; a by-area bill whose
    resident has no room gets a null amount (the insert would be refused).
    """
    fc = t["fee_categories"].select(F.col("category_id").alias("fc_id"), "calc_method", "unit_price")
    area = resident_areas(t)
    nb = new_bills
    joined = (nb.join(fc, nb.category_id == fc.fc_id, "left")
                .join(area, nb.resident_id == area.ra_resident_id, "left"))
    amount = price(F.col("calc_method"), F.col("unit_price"), F.col("ra_area"), nb.amount.cast(MONEY))
    return joined.select(*[amount.alias("amount") if c == "amount" else nb[c] for c in nb.columns])


def generate_bills(t, periods: Iterable[str] | str | None = None, as_of=None) -> DataFrame:
    """B2: every resident with a room × every category × each period, minus bills already there.

    Amount as B1, due on the 25th, status 待缴, nothing paid.  A malformed
    period (no valid 25th) yields no bills.  Residents, category status,
    billing cycle and vehicles are not looked at, as in the reference.

    The bills are whole rows of ``fee_records``: ids go on from the largest one there, in the order
    of period, resident and category, and are pinned by a checkpoint, so they can be paid.
    Every pair of resident and category is the result itself, hence the product; how the
    catalogue travels is left to Spark.
    """
    if periods is None:                       # default: the month of as_of (or of today)
        when = as_of if isinstance(as_of, datetime) else (datetime.fromisoformat(str(as_of)) if as_of
                                                          else datetime.now())
        periods = when.strftime("%Y-%m")
    plist = [periods] if isinstance(periods, str) else list(dict.fromkeys(periods))   # each period once
    cats = t["fee_categories"].select("category_id", "calc_method", "unit_price")
    per = F.array(*[F.struct(F.lit(p).alias("fee_period"), due_date_of(F.lit(p)).alias("due_date"))
                    for p in plist]) if plist else F.array().cast("array<struct<fee_period:string,due_date:date>>")
    housed = resident_areas(t).select(F.col("ra_resident_id").alias("resident_id"), F.col("ra_area").alias("area"))
    dated = (housed.select("resident_id", "area", F.explode(per).alias("p"))
                   .filter(F.col("p.due_date").isNotNull()))
    pairs = dated.crossJoin(cats)
    existing = (t["fee_records"].filter(F.col("fee_period").isin(plist))
                .select(F.col("resident_id").alias("e_res"), F.col("category_id").alias("e_cat"),
                        F.col("fee_period").alias("e_per")))
    fresh = pairs.join(existing, (pairs.resident_id == existing.e_res) & (pairs.category_id == existing.e_cat)
                       & (F.col("p.fee_period") == existing.e_per), "left_anti")
    bills = fresh.select(
        "resident_id", "category_id", F.col("p.fee_period").alias("fee_period"),
        price(F.col("calc_method"), F.col("unit_price"), F.col("area")).alias("amount"),
        F.lit(0).cast(MONEY).alias("paid_amount"),
        F.lit(S.FEE_UNPAID).alias("status"),
        F.col("p.due_date").alias("due_date"))
    top = t["fee_records"].agg(F.max("fee_id")).first()[0] or 0
    bills = dense_ordinals(bills.orderBy("fee_period", "resident_id", "category_id"), "__ord")
    return fill_defaults(bills.withColumn("fee_id", F.col("__ord") + F.lit(top).cast("bigint")), "fee_records", as_of)


def payment_status(fees: DataFrame, as_of=None) -> DataFrame:
    """T2 on rows whose paid amount was just set: fully paid → 已缴 with paid_date; part paid → 部分缴纳."""
    paid, amount = F.col("paid_amount"), F.col("amount")
    full = (paid >= amount) & (paid > 0)
    part = (paid > 0) & (paid < amount)
    out = fees.withColumn("status", F.when(full, S.FEE_PAID).when(part, S.FEE_PARTIAL).otherwise(F.col("status")))
    if "paid_date" in fees.columns:
        out = out.withColumn("paid_date", F.when(full, _as_of(as_of).cast("date")).otherwise(F.col("paid_date")))
    return out


# ----------------------------------------------------------------------------- B3: the payment fold

# Outcome codes inside the fold (mapped back to the reason texts on the JVM side).
BAD_SEQUENCE, BAD_AMOUNT = "BAD_SEQUENCE", "BAD_AMOUNT"      # no usable place in the order; amount out of range
_REASONS = [OK, UNKNOWN_FEE, ALREADY_PAID, NON_POSITIVE, OVERPAY, BAD_SEQUENCE, BAD_AMOUNT]
_OK, _UNKNOWN, _ALREADY, _NONPOS, _OVER, _NOSEQ, _RANGE = range(7)
# Status codes: 0 = the bill's status before the batch, 1 = 部分缴纳, 2 = 已缴.
_KEEP, _PART, _PAID = 0, 1, 2

# Positions folded in lock-step across all bills of a batch; a bill with more payments
# continues with the run-skipping loop below.
LOCKSTEP_POSITIONS = 64
_SCAN = 4096

_FOLD_OUT = ("fee_id long, seq int, amt_c long, amt_null boolean, status0_i int, status0_x string, reason int, "
             "paid_c long, code int")


def _fold_batches(batches: Iterator[pd.DataFrame], finals: bool = False) -> Iterator[pd.DataFrame]:
    """Exact payment fold over rows sorted by (fee_id, seq); money in integer cents.

    All bills of an Arrow batch advance together, one payment position per
    numpy step; payments past ``LOCKSTEP_POSITIONS`` of one bill are walked in
    runs: refused ones up to the next payment that fits, accepted ones up to
    the first that no longer does, each run classified in bulk.  A bill that spans batches carries its state over.

    With ``finals`` one row per bill is emitted instead — its state after the
    batch — as soon as the stream has moved past the bill.
    """
    import numpy as np

    carry = None     # (fee_id, paid, code, fired) of the last bill of the previous batch

    def final_frame(fees, paids, codes, fired):
        return pd.DataFrame({"fee_id": np.asarray(fees, np.int64), "paid_c": np.asarray(paids, np.int64),
                             "code": np.asarray(codes, np.int32), "fired": np.asarray(fired, bool)})

    for pdf in batches:
        n = len(pdf)
        if n == 0:
            continue
        fee = pdf["fee_id"].to_numpy(np.int64)
        x = pdf["amt_c"].to_numpy(np.int64)
        xnull = pdf["amt_null"].to_numpy(bool)
        A = pdf["amount_c"].to_numpy(np.int64)
        known = pdf["known"].to_numpy(bool)
        start = np.ones(n, bool)
        start[1:] = fee[1:] != fee[:-1]
        g = np.cumsum(start) - 1
        first = np.flatnonzero(start)
        pos = np.arange(n) - first[g]
        gA = A[first]
        gknown = known[first]
        paid = pdf["paid0_c"].to_numpy(np.int64)[first].copy()
        code = np.zeros(len(first), np.int64)
        fired = np.zeros(len(first), bool)          # an acceptance made the bill 已缴 (paid_date = as_of)
        closed0 = pdf["closed0"].to_numpy(bool)[first]
        if carry is not None and fee[0] == carry[0]:
            paid[0], code[0], fired[0] = carry[1], carry[2], carry[3]
        elif carry is not None and finals:
            yield final_frame([carry[0]], [carry[1]], [carry[2]], [carry[3]])
        reason = np.empty(n, np.int64)
        paid_after = np.empty(n, np.int64)
        code_after = np.empty(n, np.int64)

        def step(rows):
            gs = g[rows]
            closed = (closed0[gs] & (code[gs] == _KEEP)) | (code[gs] == _PAID)
            xv = x[rows]
            tot = paid[gs] + xv
            r = np.where(~gknown[gs], _UNKNOWN, np.where(closed, _ALREADY, np.where(
                xnull[rows] | (xv <= 0), _NONPOS, np.where(tot > gA[gs], _OVER, _OK))))
            ok = r == _OK
            og = gs[ok]
            paid[og] = tot[ok]
            pa, aa = paid[og], gA[og]
            code[og] = np.where((pa >= aa) & (pa > 0), _PAID, np.where((pa > 0) & (pa < aa), _PART, code[og]))
            fired[og] |= code[og] == _PAID
            reason[rows] = r
            paid_after[rows] = paid[gs]
            code_after[rows] = code[gs]

        top = int(pos.max())
        for p in range(min(top, LOCKSTEP_POSITIONS - 1) + 1):
            step(np.flatnonzero(pos == p))
        if top >= LOCKSTEP_POSITIONS:
            ends = np.append(first[1:], n)
            for gi in np.flatnonzero(ends - first > LOCKSTEP_POSITIONS).tolist():
                i, end, span = first[gi] + LOCKSTEP_POSITIONS, ends[gi], 16
                while i < end:
                    closed = (closed0[gi] and code[gi] == _KEEP) or code[gi] == _PAID
                    if not gknown[gi] or closed:
                        rows = np.arange(i, end)
                        step(rows)            # every remaining payment gets the same outcome
                        break
                    room = gA[gi] - paid[gi]
                    seg = slice(i, min(i + _SCAN, end))
                    fits = ~xnull[seg] & (x[seg] > 0) & (x[seg] <= room)
                    j = i + int(np.argmax(fits)) if fits.any() else seg.stop
                    if j > i:                 # refused run: nothing changes inside it
                        rows = np.arange(i, j)
                        reason[rows] = np.where(xnull[rows] | (x[rows] <= 0), _NONPOS, _OVER)
                        paid_after[rows] = paid[gi]
                        code_after[rows] = code[gi]
                    i = j
                    if j < seg.stop:          # accepted run: up to the first payment that no longer fits
                        rows = np.arange(j, min(j + span, end))
                        good = ~xnull[rows] & (x[rows] > 0)
                        total = np.cumsum(np.where(good, x[rows], 0))
                        stop = np.flatnonzero((total > room) | (np.r_[0, total[:-1]] == room))
                        rows = rows[:stop[0]] if len(stop) else rows
                        good, total = good[:len(rows)], paid[gi] + total[:len(rows)]
                        reason[rows] = np.where(good, _OK, _NONPOS)
                        paid_after[rows] = total
                        code_after[rows] = np.where(total >= gA[gi], _PAID, _PART)
                        paid[gi], code[gi] = total[-1], code_after[rows[-1]]
                        fired[gi] |= code[gi] == _PAID
                        i, span = j + len(rows), min(2 * span, _SCAN) if len(rows) == span else 16
        carry = (fee[-1], paid[-1], code[-1], fired[-1])
        if finals:
            if len(first) > 1:
                yield final_frame(fee[first[:-1]], paid[:-1], code[:-1], fired[:-1])
            continue
        yield pd.DataFrame({"fee_id": fee, "seq": pdf["seq"].to_numpy(np.int32), "amt_c": x, "amt_null": xnull,
                            "status0_i": pdf["status0_i"].to_numpy(np.int32), "status0_x": pdf["status0_x"],
                            "reason": reason.astype(np.int32),
                            "paid_c": paid_after, "code": code_after.astype(np.int32)})
    if finals and carry is not None:
        yield final_frame([carry[0]], [carry[1]], [carry[2]], [carry[3]])


def _cents(c: Column) -> Column:
    return (c.cast(MONEY) * 100).cast("bigint")


def _money(c: Column) -> Column:
    return (c.cast("decimal(20,0)") / 100).cast(MONEY)


def post_payments(fees: DataFrame, payments: DataFrame) -> DataFrame:
    """Apply payments (fee_id, seq, pay_amount) to bills in seq order, one outcome per payment.

    Checks, in order: unknown bill; bill already 已缴; amount ≤ 0; paid + amount
    above the amount owed; else accepted.  A refused payment adds nothing and
    later payments are still tried; status follows T2 after every acceptance.
    Out: fee_id, seq, pay_amount, reason, paid_after, status_after.

    Plan: payments ⟕ bill state on fee_id (AQE picks broadcast or sort-merge
    and splits skewed partitions), then one hash exchange on fee_id with a sort
    by (fee_id, seq), and an Arrow-batched fold.  A bill's payments form one
    ordered chain — a refusal depends on every acceptance before it — so the
    fold streams a bill through one task, without holding its payments in memory.
    Bills with more than ``HOT_PAYMENTS`` payments in the batch (counted first, one
    map-side aggregate) are posted in chunks instead (:mod:`.payment_chunks`).
    """
    cold, chunks = _cold_and_chunks(fees, payments)
    early, late = _split(fees, cold)
    folded = _sorted_for_fold(late).mapInPandas(_fold_batches, _FOLD_OUT)
    if chunks is not None:
        early = early.unionByName(chunks.early)
        folded = folded.unionByName(chunks.outcomes(_FOLD_OUT, _CODES))
    folded = folded.unionByName(early.select(
        "fee_id", "seq", "amt_c", "amt_null", "status0_i", "status0_x", F.col("early").alias("reason"),
        F.col("paid0_c").alias("paid_c"), F.lit(_KEEP).alias("code")))
    reason = F.element_at(F.array(*[F.lit(r) for r in _REASONS]), F.col("reason") + 1)
    unknown = F.col("reason") == _UNKNOWN
    return folded.select(
        "fee_id", "seq",
        F.when(F.col("amt_null"), F.lit(None).cast(MONEY)).otherwise(_money(F.col("amt_c"))).alias("pay_amount"),
        reason.alias("reason"),
        F.when(unknown, F.lit(None).cast(MONEY)).otherwise(_money(F.col("paid_c"))).alias("paid_after"),
        F.when(unknown, F.lit(None).cast("string")).when(F.col("code") == _PAID, F.lit(S.FEE_PAID))
         .when(F.col("code") == _PART, F.lit(S.FEE_PARTIAL))
         .when(F.col("status0_i") > 0, F.element_at(_STATUS_ARRAY(), F.col("status0_i")))
         .otherwise(F.col("status0_x"))
         .alias("status_after"))


def _STATUS_ARRAY() -> Column:
    return F.array(*[F.lit(v) for v in S.FEE_STATUS])


def _split(fees: DataFrame, payments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payments with their bill's state: those refused whatever came before them, and those for the fold.

    The early ones need no order, so a NULL or unknown key that very many share meets no task."""
    joined = _with_state(fees, payments)
    return joined.where("early is not null"), joined.where("early is null").drop("early")


def _with_state(fees: DataFrame, payments: DataFrame) -> DataFrame:
    """Payments with their bill's state; ``early``: the reason of those refused whatever came before them (no such
    bill, bill closed from the start, no usable seq or amount)."""
    seq, amount = F.col("seq").try_cast("int"), F.col("pay_amount").try_cast(MONEY)
    pay = payments.select("fee_id", seq.alias("seq"), F.coalesce((amount * 100).cast("bigint"), F.lit(0)).alias("amt_c"),
                          amount.isNull().alias("amt_null"), seq.isNull().alias("no_seq"),
                          (F.col("pay_amount").isNotNull() & amount.isNull()).alias("range"))
    led = fees.select(F.col("fee_id").alias("l_fee_id"), _cents(F.col("amount")).alias("amount_c"),
                      _cents(F.col("paid_amount")).alias("paid0_c"), F.col("status").alias("status0"))
    joined = pay.join(led, pay.fee_id == led.l_fee_id, "left").select(
        "fee_id", "seq", "amt_c", "amt_null", "no_seq", "range", F.coalesce("amount_c", F.lit(0)).alias("amount_c"),
        F.coalesce("paid0_c", F.lit(0)).alias("paid0_c"),
        # the starting status travels as its position in the declared domain (text only if outside it)
        F.coalesce(F.array_position(_STATUS_ARRAY(), F.col("status0")), F.lit(0)).cast("int").alias("status0_i"),
        F.when(~F.coalesce(F.col("status0").isin(list(S.FEE_STATUS)), F.lit(False)), F.col("status0"))
         .alias("status0_x"),
        F.coalesce(F.col("status0") == S.FEE_PAID, F.lit(False)).alias("closed0"),
        F.col("l_fee_id").isNotNull().alias("known"))
    return joined.withColumn("early", F.when(~F.col("known"), _UNKNOWN).when(F.col("closed0"), _ALREADY)
                               .when(F.col("no_seq"), _NOSEQ).when(F.col("range"), _RANGE)).drop("no_seq", "range")


#: What the chunked posting calls the fold's reasons and states.
_CODES = {"ok": _OK, "closed": _ALREADY, "none": _NONPOS, "over": _OVER, "keep": _KEEP, "part": _PART, "paid": _PAID}


def _cold_and_chunks(fees: DataFrame, payments: DataFrame) -> tuple[DataFrame, Chunks | None]:
    """The payments without those of hot bills, and these in chunks (None: no bill is hot)."""
    hot, rows = hot_bills(payments.where(F.col("fee_id").isNotNull()))
    if hot is None:
        return payments, None
    mine = payments.join(hot, "fee_id", "left_semi")
    return payments.join(hot, "fee_id", "left_anti"), Chunks(_with_state(fees, mine), mine, rows)


def _sorted_for_fold(joined: DataFrame) -> DataFrame:
    """Hash-partitioned on fee_id and sorted by (fee_id, seq)."""
    ship_package(joined.sparkSession)            # the fold runs in Python workers
    # The exchange is keyed on a column of its own (a hash of fee_id), never on fee_id itself: an
    # exchange on fee_id would be dropped when the join above already hash-partitions on fee_id,
    # and AQE may split a skewed join partition — one bill would then fold in two tasks.  An
    # exchange Spark must keep is one AQE only coalesces (whole partitions), never splits.
    return (joined.withColumn("__fold_part", F.xxhash64("fee_id")).repartition("__fold_part")
                  .sortWithinPartitions("fee_id", "seq", "amt_null", "amt_c").drop("__fold_part"))


def settle(fees: DataFrame, payments: DataFrame, as_of=None) -> DataFrame:
    """The bill table after a payment batch, in its own schema: paid amount, status (T2), paid date.

    The fold emits one final state per bill (each bill is whole and ordered in
    its task), so no second aggregation over the payment outcomes is needed.
    """
    cold, chunks = _cold_and_chunks(fees, payments)
    finals = _sorted_for_fold(_split(fees, cold)[1]).mapInPandas(
        lambda it: _fold_batches(it, finals=True), "fee_id long, paid_c long, code int, fired boolean")
    if chunks is not None:
        finals = finals.unionByName(chunks.finals(_CODES))
    finals = finals.select(F.col("fee_id").alias("s_fee_id"), "paid_c", "code", "fired")
    f = fees
    j = f.join(finals, f.fee_id == finals.s_fee_id, "left")
    hit = F.col("s_fee_id").isNotNull()
    new = {
        "paid_amount": F.when(hit, _money(F.col("paid_c"))).otherwise(f.paid_amount),
        "status": F.when(F.col("code") == _PAID, F.lit(S.FEE_PAID)).when(F.col("code") == _PART, F.lit(S.FEE_PARTIAL))
                   .otherwise(f.status),
        "paid_date": F.when(F.col("fired"), _as_of(as_of).cast("date")).otherwise(f.paid_date),
    }
    return j.select(*[new[c].alias(c) if c in new else f[c] for c in fees.columns])


def ledger_after_payments(fees: DataFrame, payments: DataFrame, categories: DataFrame, as_of=None) -> DataFrame:
    """Every bill after the batch — paid amount, status (T2), paid date, remaining, category name."""
    led = settle(fees, payments, as_of)
    fc = categories.select(F.col("category_id").alias("c_id"), "category_name")
    return led.join(fc, led.category_id == fc.c_id, "left").select(
        "fee_id", "resident_id", "category_id", "category_name", "amount", "paid_amount",
        (F.col("amount") - F.col("paid_amount")).cast(MONEY).alias("remaining"), "status", "paid_date",
        "fee_period")
