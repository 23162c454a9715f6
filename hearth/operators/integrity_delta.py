"""Group rules (I1, I2, I7) kept up to date by change batches instead of read anew.

Each rule counts the rows of its groups: a key, a unique key under the collation, a bill's resident, category and
period.  The counts are a table of their own; a batch's inserted and deleted rows are counted the same way and added to
the groups they touch.  Violations after the batch are the earlier ones of untouched groups and the touched groups whose
new count breaks the rule; the rule's table is not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..sources.derived import LazyTables
from . import integrity as I
from .integrity import COLLATION

BILL = ("resident_id", "category_id", "fee_period")


@dataclass(frozen=True)
class Rule:
    """Rows of ``table`` grouped by ``columns``; ``text`` ones under the collation (a null there belongs to no group)."""

    name: str                      # pk, unique or bills
    table: str
    columns: tuple[str, ...]

    @property
    def text(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if self.name == "unique" and S.TABLES[self.table].column(c).dtype == "string")


def rules(name: str, tables=None) -> list[Rule]:
    """All rules of a kind (of some tables)."""
    specs = [s for n, s in S.TABLES.items() if tables is None or n in tables]
    if name == "pk":
        return [Rule("pk", s.name, (s.key,)) for s in specs]
    if name == "unique":
        return [Rule("unique", s.name, u) for s in specs for u in s.uniques]
    return [Rule("bills", s.name, BILL) for s in specs if s.name == "fee_records"]


def group_counts(rule: Rule, rows: DataFrame, sign: int = 1, size: int | None = None) -> DataFrame:
    """``k0, k1, .., n``: the rule's groups among ``rows``; of text the smallest spelling stands for its group.

    Nearly every row of a large table (``size`` rows at most, None: not known) is a group of the key rule: these are
    dealt to as many tasks as the rows ask for, so that no task holds the groups of several tables, or a share that grows."""
    if rule.name == "pk" and size is not None and size > I.KEYS_A_TASK:
        keys = rows.select(F.col(rule.columns[0]).alias("k0"))
        return I.counted(keys, size).groupBy("k0").agg((F.sum("m") * sign).alias("n"))
    if rule.name == "unique":
        rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in rule.columns))
    keys = [(F.collate(F.col(c), COLLATION) if c in rule.text else F.col(c)).alias(f"g{i}") for i, c in enumerate(rule.columns)]
    shown = [F.min(c).alias(f"k{i}") if c in rule.text else F.first(c).alias(f"k{i}") for i, c in enumerate(rule.columns)]
    return rows.groupBy(*keys).agg(*shown, (F.count(F.lit(1)) * sign).alias("n")).select(*[f"k{i}" for i in range(len(keys))], "n")


def added(rule: Rule, counts: DataFrame, inserted: DataFrame | None, deleted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The groups a batch touches, with their counts before (``old``) and after (``n``); and the whole counts after it.

    Of a text group the smallest spelling ever counted stays its name."""
    width = len(rule.columns)
    parts = [group_counts(rule, d, sign) for d, sign in ((inserted, 1), (deleted, -1)) if d is not None]
    delta = reduce(DataFrame.unionByName, parts)
    names = [f"k{i}" for i in range(width)]

    def folded(df: DataFrame) -> DataFrame:
        return df.select("*", *[(F.collate(F.col(k), COLLATION) if c in rule.text else F.col(k)).alias(f"j{i}")
                                for i, (k, c) in enumerate(zip(names, rule.columns, strict=True))])

    both = folded(counts.select(*names, F.col("n").alias("old"), F.lit(0).cast("bigint").alias("more"), F.lit(0).alias("new"))
                  .unionByName(delta.select(*names, F.lit(0).cast("bigint").alias("old"), F.col("n").alias("more"), F.lit(1).alias("new"))))
    shown = [F.min(k).alias(k) if c in rule.text else F.first(k).alias(k) for k, c in zip(names, rule.columns, strict=True)]
    merged = both.groupBy(*[f"j{i}" for i in range(width)]).agg(
        *shown, F.sum("old").alias("old"), F.sum("more").alias("more"), F.max("new").alias("new"))
    merged = merged.select(*names, "old", (F.col("old") + F.col("more")).alias("n"), "new")
    return merged.where("new = 1").drop("new"), merged.where("n > 0").select(*names, "n")


def _violations(rule: Rule, counts: DataFrame) -> DataFrame:
    """The rule's rows, as :mod:`.integrity` lists them, for groups that break it."""
    if rule.name == "pk":
        return counts.where("n > 1 or (k0 is null and n > 0)").select(F.lit(rule.table).alias("table_name"), F.col("k0").alias("key_value"), "n")
    if rule.name == "unique":
        text = F.concat_ws("|", *[F.col(f"k{i}").cast("string") for i in range(len(rule.columns))])
        return counts.where("n > 1").select(F.lit(rule.table).alias("table_name"), F.lit(",".join(rule.columns)).alias("constraint_name"),
                                            text.alias("key_text"), "n")
    return counts.where("n > 1").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(rule.columns)], "n")


def state(name: str, t: Mapping[str, DataFrame]) -> dict[Rule, DataFrame]:
    """The counts of all rules of a kind; to be written and handed to :func:`violations_after` with the next batch."""
    size = t.rows_of if isinstance(t, LazyTables) and name == "pk" else lambda table: None
    return {r: group_counts(r, t[r.table], size=size(r.table)) for r in rules(name)}


def violations(counts: Mapping[Rule, DataFrame]) -> DataFrame:
    """The full listing, from the counts."""
    return reduce(DataFrame.unionByName, [_violations(r, c) for r, c in counts.items()])


def violations_after(counts: Mapping[Rule, DataFrame], before: DataFrame, batches: Mapping[str, tuple[DataFrame | None, DataFrame | None]]) -> DataFrame:
    """The listing after a batch, from the listing ``before`` it: per table its inserted and deleted rows (or None).

    Listed rows of the groups the batch touches are taken out and those that break the rule now put in."""
    out, changed = before, []
    for rule, c in counts.items():
        if rule.table in batches:
            touched, _ = added(rule, c, *batches[rule.table])
            was, now = (_violations(rule, touched.select(*[k for k in touched.columns if k.startswith("k")], F.col(x).alias("n")))
                        for x in ("old", "n"))
            changed += [was.withColumn("__sign", F.lit(-1)), now.withColumn("__sign", F.lit(1))]
    if not changed:
        return before
    cols = [c for c in out.columns if c != "n"]
    rows = reduce(DataFrame.unionByName, [out.withColumn("__sign", F.lit(1)), *changed])
    if "key_text" in cols:
        # a group's name can change to a smaller spelling: the old name goes with its count
        keys = [F.col(c) if c != "key_text" else F.collate(F.col(c), COLLATION).alias("__text") for c in cols]
        return (rows.groupBy(*keys).agg(F.min("key_text").alias("key_text"), F.sum(F.col("n") * F.col("__sign")).alias("n"))
                .where("n > 0").select(*out.columns))
    return rows.groupBy(*cols).agg(F.sum(F.col("n") * F.col("__sign")).alias("n")).where("n > 0").select(*out.columns)
