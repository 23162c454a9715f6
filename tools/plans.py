"""Write PLANS.md: the executed (AQE-final) physical plan of every job, condensed.

Usage: python tools/plans.py [sf_dir]   (runs each job once over the estate tables written as Parquet)
"""

from __future__ import annotations

import os
import re
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hearth import registry  # noqa: E402
from hearth.operators import reports as R  # noqa: E402
from hearth.session import build_session, ensure_checkpoint_dir  # noqa: E402
from hearth.sources.parquet import load_estate, read_estate, write_estate  # noqa: E402

KEEP = ("Scan", "Join", "Exchange", "Aggregate", "Window", "Sort", "Union", "MapInPandas", "Generate",
        "TakeOrdered", "Broadcast", "AQEShuffleRead")


def condense(plan: str) -> list[str]:
    out = []
    for line in plan.split("\n"):
        body = line.lstrip(" :+-")
        if not body.startswith(KEEP) and "FileScan" not in body:
            continue
        indent = line[: len(line) - len(body)]
        body = re.sub(r"#\d+L?", "", body)
        if "FileScan" in body:
            table = re.search(r"estate[^/]*/([a-z_]+)", body)
            pushed = re.search(r"PushedFilters: \[([^\]]*)\]", body)
            part = re.search(r"PartitionFilters: \[([^\]]*)\]", body)
            schema = re.search(r"ReadSchema: struct<([^>]*)>", body)
            ncols = schema.group(1).count(":") if schema else 0
            body = (f"Scan {table.group(1) if table else '?'} cols={ncols}"
                    + (f" pushed=[{pushed.group(1)[:120]}]" if pushed and pushed.group(1) else "")
                    + (f" partition=[{part.group(1)[:80]}]" if part and part.group(1) else ""))
        out.append((indent + body)[:170])
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 16, extra={"spark.sql.maxMetadataStringLength": "2000"})
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/plans-estate-{uuid.uuid4().hex[:8]}"
    write_estate(load_estate(spark, sf), root)
    t = read_estate(spark, root)
    jobs = dict(registry.jobs())
    jobs["fee_report(period='1998-03')"] = lambda t: R.fee_report(t, "1998-03")
    lines = ["# Executed plans", "",
             f"Condensed AQE-final physical plans of every job over the estate tables derived from `{sf}` and",
             "written as Parquet (bills partitioned by `fee_period`).  `cols` = columns the scan reads;",
             "`pushed` = filters handed to the Parquet reader; `partition` = partition pruning.", ""]
    for k, job in jobs.items():
        df = job(t)
        df.write.format("noop").mode("overwrite").save()
        lines += [f"## {k}", "", "```"] + condense(df._jdf.queryExecution().executedPlan().toString()) + ["```", ""]
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write(
        "\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main()
