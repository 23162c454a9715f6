"""Skew check: the same jobs on the estate and on a copy where ONE key holds a third of the rows.

Usage: python tools/skew_check.py [sf_dir [job ...]]
The skewed copy is derived from the estate by Spark: resident 1 owns every third bill, repair
order, complaint and visit; one bill receives every third payment.  Prints one JSON line with
the wall seconds of each job on both (median of 3 after a warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from hearth.operators import billing as B  # noqa: E402
from hearth.operators import changes as M  # noqa: E402
from hearth.operators import integrity as I  # noqa: E402
from hearth.operators import reports as R  # noqa: E402
from hearth.session import build_session, ensure_checkpoint_dir  # noqa: E402
from hearth.sources import batches as X  # noqa: E402
from hearth.sources.derived import LazyTables  # noqa: E402
from hearth.sources.parquet import load_estate, read_estate, write_estate  # noqa: E402

HOT = 1
CHILDREN = {"fee_records": "fee_id", "repair_orders": "order_id", "complaints": "complaint_id",
            "visitor_records": "visitor_id"}


def skewed(t) -> LazyTables:
    def build(n):
        if n in CHILDREN:
            k = CHILDREN[n]
            return lambda: t[n].withColumn("resident_id", F.when(F.col(k) % 3 == 0, F.lit(HOT).cast("bigint"))
                                           .otherwise(F.col("resident_id")))
        return lambda: t[n]
    return LazyTables({n: build(n) for n in t})


def hot_payments(t):
    p = X.payments(t)
    hot_fee = t["fee_records"].agg(F.min("fee_id")).first()[0]
    third = (F.col("fee_id") + F.col("seq")) % 3 == 0
    return p.select(F.when(third, F.lit(hot_fee)).otherwise(F.col("fee_id")).alias("fee_id"),
                    F.when(third, (F.col("fee_id") % 100000000) * 10 + F.col("seq")).otherwise(F.col("seq"))
                     .cast("int").alias("seq"), "pay_amount")


def step_changes(t, hot: bool):
    """Ten status steps for every order, in order of ``seq``; ``hot``: a third of them on one order."""
    x = t["repair_orders"].select("order_id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("k"))
    seq = (F.col("order_id") * 16 + F.col("k")).alias("seq")
    key = F.when(seq % 3 == 0, F.lit(HOT).cast("bigint")).otherwise(F.col("order_id")) if hot else F.col("order_id")
    return x.select(key.alias("order_id"), seq, F.element_at(F.array(*[F.lit(v) for v in ("待处理", "处理中", "已完成")]),
                                                            (F.col("k") % 3 + 1).cast("int")).alias("status"))


JOBS = {
    "repair_completion": lambda t, p: M.repair_completion(t["repair_orders"], CHANGES[p], X.AS_OF),
    "resident_overview": lambda t, p: R.resident_overview(t),
    "resident_recent_repairs": lambda t, p: R.resident_recent_repairs(t),
    "resident_unpaid": lambda t, p: R.resident_unpaid(t),
    "fee_list": lambda t, p: R.fee_list(t),
    "repair_board": lambda t, p: R.repair_board(t),
    "visitor_log": lambda t, p: R.visitor_log(t),
    "fk_orphans": lambda t, p: I.fk_orphans(t),
    "duplicate_bills": lambda t, p: I.duplicate_bills(t),
    "post_payments": lambda t, p: B.post_payments(t["fee_records"], PAYMENTS[p]),
    "ledger_after_payments": lambda t, p: B.ledger_after_payments(t["fee_records"], PAYMENTS[p], t["fee_categories"]),
}


CHANGES: dict[str, object] = {}
PAYMENTS: dict[str, object] = {}


def timed(make) -> float:
    """Seconds to plan and run a job, what it runs while it is planned included."""
    s = time.time()
    df = make()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - s


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 16)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/skew-estate-{uuid.uuid4().hex[:8]}"
    write_estate(load_estate(spark, sf), root + "/even")
    even = read_estate(spark, root + "/even")
    write_estate(skewed(even), root + "/hot")
    hot = read_estate(spark, root + "/hot")
    PAYMENTS.update(even=X.payments(even), hot=hot_payments(even))
    CHANGES.update(even=step_changes(even, False), hot=step_changes(even, True))
    out = {}
    names = sys.argv[2:] or list(JOBS)
    for name, job in ((n, JOBS[n]) for n in names):
        row = {}
        for label, t in (("even", even), ("hot", hot)):
            timed(lambda: job(t, label))                                                  # noqa: B023
            row[label] = round(statistics.median(timed(lambda: job(t, label)) for _ in range(3)), 3)   # noqa: B023
        out[name] = row
    print(json.dumps({"sf": sf, "hot_share": "1/3", "seconds": out}, ensure_ascii=False))
    spark.stop()


if __name__ == "__main__":
    main()
