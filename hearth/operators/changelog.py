"""A session's mixed change log: inserts, updates and deletes of several tables in one order.

The log's net effect is found per table, parents first, without replaying the tables:

* a table's rows have *lives* — from an insert (or from before the log) to a delete, of their own or of the parent
  they point at; a child's events look up, by their reference, whether the parent lives at that moment and when this
  life ends;
* the events that decide over lives (inserts, deletes, changed references) are folded per key in order, streamed with
  a state of a few numbers;
* values need no order but the last: per column the latest accepted update after the final life's start, a partial
  aggregate, so a key with very many updates is reduced before the shuffle.

Tables without events, and rows no event reaches, pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..plans.lineage import cut_lineage
from ..session import ship_package
from .changes import fill_defaults, rule_findings

BEFORE = -1                   # the start of lives older than the log; ``seq`` is 0 or more


def _fold(refs: int, cascades: tuple[bool, ...], reasons: list[str]):
    """The fold over a key's structural events, sorted by key and seq.

    A row of input: key, seq, op, and per reference whether the event sets it, whether its parent lives then (a null
    reference does), and when that life ends.  Out, per row: key, kind ('life': start, end; 'end': start and
    which references were nulled; 'no': a refused event with its reason), a, b, nulled, why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, alive, start, ends = None, False, BEFORE, [None] * refs
        out: list[tuple] = []

        def dies():
            times = [e for e, c in zip(ends, cascades, strict=True) if c and e is not None]
            return min(times) if times else None

        def close(at=None):
            """The life ends with the parent's if that is before ``at`` (None: the end of the log)."""
            nonlocal alive
            d = dies() if alive else None
            if d is not None and (at is None or d < at):
                out.append((key, "life", start, d, 0, None))
                alive = False

        def finish():
            close()
            if alive:
                out.append((key, "life", start, None, 0, None))
                nulled = sum(1 << i for i, (e, c) in enumerate(zip(ends, cascades, strict=True)) if not c and e is not None)
                out.append((key, "end", start, None, nulled, None))

        def flush():
            nonlocal out
            rows, out = out, []
            c = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)],
                                              ["key", "kind", "a", "b", "nulled", "why"])

        for b in batches:
            for k, seq, op, bad, *ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if key is not None:
                        finish()
                    key, alive, start, ends = k, False, BEFORE, [None] * refs
                close(seq)
                given = [(ref[3 * i], ref[3 * i + 1], ref[3 * i + 2]) for i in range(refs)]
                lost = next((reasons[i] for i, (s, ok, _) in enumerate(given) if s and not ok), None)
                if op == "D":
                    if alive:
                        out.append((key, "life", start, seq, 0, None))
                        alive = False
                elif op == "U":
                    if not alive:
                        out.append((key, "no", seq, None, 0, None))           # nothing there: no effect, no refusal
                    elif bad or lost:
                        out.append((key, "no", seq, None, 0, bad or lost))
                    else:
                        ends = [d if s else e for (s, _, d), e in zip(given, ends, strict=True)]
                elif alive and op == "I":
                    out.append((key, "no", seq, None, 0, "PK"))
                elif op == "I" and (bad or lost):
                    out.append((key, "no", seq, None, 0, bad or lost))
                else:
                    alive, start, ends = True, seq, [d for _, _, d in given]
            yield flush()
        if key is not None:
            finish()
        yield flush()

    return run


def apply_log(t: Mapping[str, DataFrame], log: Mapping[str, DataFrame], as_of=None, only: set[str] | None = None) -> dict[str, DataFrame]:
    """The tables the log reaches (of them ``only`` these, default all), after it; and ``rejected``: ``table_name, row_key, seq, reason``.

    ``log``: per table its events — ``seq`` (0 or more, one order over all tables, at most one event of a key at a
    time), ``op`` (I, U or D), the key, and values.  An update sets the columns named in ``fields`` (null or absent: all the
    frame carries).  A delete takes the children along or clears their reference, as declared, at that moment; a
    key may come back later, with new defaults.  Refused: inserts of a living key (PK), inserts and updates that break a row
    rule or point at a parent not living then.  Updates and deletes of what is not there do nothing.  Events without a key or
    ``seq`` are refused (``NO_KEY``).  Unique rules are left to the checks of the result.
    """
    after: dict[str, DataFrame] = {}
    lives: dict[str, DataFrame] = {}                                    # key, a (start), b (end or null) of reached keys
    rejected: list[DataFrame] = []
    for table in S.TABLE_ORDER:
        spec = S.TABLES[table]
        if table in log:
            after[table], lives[table], no = _one_table(t, log[table], spec, lives, as_of)
            rejected.append(no)
        elif any(r.parent in lives for r in spec.refs) and (only is None or _feeds(table, only | set(log))):
            after[table], lives[table] = _reached(t, spec, lives)
    if rejected:
        after["rejected"] = reduce(DataFrame.unionByName, rejected)
    return after


def _feeds(table: str, wanted: set[str]) -> bool:
    """Is the table wanted itself, or does a wanted one hang on it?"""
    return table in wanted or any(_feeds(child, wanted) for child, _ in S.CHILDREN.get(table, []))


def _reached(t, spec: S.Table, lives: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A table without events of its own: its rows go, or lose a reference, when the parent's first life ends."""
    rows = t[spec.name].select(*spec.names)
    death = F.lit(None).cast("bigint")
    for i, r in enumerate(spec.refs):
        if r.parent in lives:
            ended = lives[r.parent].where((F.col("a") == BEFORE) & F.col("b").isNotNull()).select(
                F.col("key").alias(f"__p{i}"), F.col("b").alias(f"__b{i}"))
            rows = rows.join(ended, rows[r.column] == ended[f"__p{i}"], "left").drop(f"__p{i}")
            if r.on_delete == "cascade":
                death = F.least(death, F.col(f"__b{i}"))                     # nulls are skipped
            else:
                rows = rows.withColumn(r.column, F.when(F.col(f"__b{i}").isNull(), F.col(r.column)))
    rows = rows.withColumn("__death", death)
    gone = rows.where(F.col("__death").isNotNull()).select(F.col(spec.key).alias("key"), F.lit(BEFORE).cast("bigint").alias("a"),
                                                            F.col("__death").alias("b"))
    if S.CHILDREN.get(spec.name):
        gone = cut_lineage(gone)
    return rows.where(F.col("__death").isNull()).select(*spec.names), gone


def _parent_lives(t, events: DataFrame, r: S.Reference, i: int, lives: Mapping[str, DataFrame]) -> DataFrame:
    """``events`` plus ``ok{i}`` (the parent lives at ``seq``; a null reference does) and ``end{i}`` (that life's end)."""
    ref = F.col(r.column)
    known = t[r.parent].select(F.col(r.parent_key).alias("__pk"))
    if r.parent not in lives:
        j = events.join(known, ref == F.col("__pk"), "left")
        return j.withColumn(f"ok{i}", ref.isNull() | F.col("__pk").isNotNull()).withColumn(
            f"end{i}", F.lit(None).cast("bigint")).drop("__pk")
    reached = lives[r.parent]
    still = known.join(reached.select(F.col("key").alias("__pk")).distinct(), "__pk", "left_anti").select(
        "__pk", F.lit(BEFORE).cast("bigint").alias("__a"), F.lit(None).cast("bigint").alias("__b"))
    spans = still.unionByName(reached.where("a is not null").select(F.col("key").alias("__pk"), F.col("a").alias("__a"), F.col("b").alias("__b")))
    at = F.greatest(F.col("seq"), F.lit(0))
    j = events.join(spans, (ref == F.col("__pk")) & (F.col("__a") < at) & (F.col("__b").isNull() | (F.col("__b") > at)), "left")
    return j.withColumn(f"ok{i}", ref.isNull() | F.col("__pk").isNotNull()).withColumn(f"end{i}", F.col("__b")).drop("__pk", "__a", "__b")


def _one_table(t, events: DataFrame, spec: S.Table, lives: Mapping[str, DataFrame], as_of):
    key, refs = spec.key, [r for r in spec.refs]
    base = t[spec.name].select(*spec.names)
    text = F.lit(None).cast("string")
    names = [c for c in spec.names if c != key]
    carried = [c for c in names if c in events.columns]
    fields = F.col("fields") if "fields" in events.columns else F.lit(None).cast("array<string>")
    own = events.select(F.col("seq").cast("bigint").alias("seq"), F.col("op").cast("string").alias("op"), F.col(key).cast("bigint").alias(key),
                        *[F.col(c).cast(S.spark_type(spec.column(c).dtype)).alias(c) for c in carried],
                        F.coalesce(fields, F.array(*[F.lit(c) for c in carried]).cast("array<string>")).alias("fields"))
    unusable = own.where(F.col(key).isNull() | F.col("seq").isNull() | (F.col("seq") < 0) | ~F.coalesce(F.col("op").isin("I", "U", "D"), F.lit(False)))
    own = own.where(F.col(key).isNotNull() & (F.col("seq") >= 0) & F.col("op").isin("I", "U", "D"))
    inserts = fill_defaults(own.where("op = 'I'").select("seq", key, *carried), spec.name, as_of, (F.col("seq"),))
    first = lambda cs: F.coalesce(*cs, text)                                                      # noqa: E731
    bad_insert = inserts.withColumn("bad", first(rule_findings(spec)))
    updates = own.where("op = 'U'")

    def broken(c: str):
        found = rule_findings(spec, {c})
        return F.when(F.array_contains("fields", c), F.coalesce(*found, text)) if found else text

    bad_update = updates.withColumn("bad", first([broken(c) for c in carried]))
    ref_cols = [r.column for r in refs]
    sets = lambda c: F.array_contains("fields", c) if c in carried else F.lit(False)             # noqa: E731

    def typed(df: DataFrame, op: str, bad, set_of) -> DataFrame:
        return df.select(F.col(key).alias("key"), "seq", F.lit(op).alias("op"), bad.alias("bad"),
                         *[(F.col(c) if c in df.columns else F.lit(None).cast("bigint")).alias(c) for c in ref_cols],
                         *[set_of(c).alias(f"set{i}") for i, c in enumerate(ref_cols)])

    # only updates that set a reference or are refused decide anything over lives
    structural = reduce(lambda a, b: a | b, [sets(c) for c in ref_cols], F.col("bad").isNotNull())
    parts = [typed(bad_insert, "I", F.col("bad"), lambda c: F.lit(True)),
             typed(bad_update.where(structural), "U", F.col("bad"), sets),
             typed(own.where("op = 'D'"), "D", text, lambda c: F.lit(False))]
    old = base.withColumn("seq", F.lit(BEFORE).cast("bigint"))
    ev = reduce(DataFrame.unionByName, [typed(old, "B", text, lambda c: F.lit(True)), *parts])
    for i, r in enumerate(refs):
        ev = _parent_lives(t, ev, r, i, lives)
    ends = [F.col(f"end{i}").isNotNull() for i in range(len(refs))]
    dying = reduce(lambda a, b: a | b, ends, F.lit(False))
    if refs:
        ev = cut_lineage(ev)
    # keys with events of their own, or whose old row loses a parent
    touched = own.select(F.col(key).alias("key")).unionByName(ev.where((F.col("op") == "B") & dying).select("key")).distinct()
    ship_package(base.sparkSession)
    # a base row whose references are dangling lives on, as nothing in the log has ended it
    ok = [F.when(F.col("op") == "B", True).otherwise(F.col(f"ok{i}")).alias(f"ok{i}") for i in range(len(refs))]
    dealt = (ev.join(touched, "key", "left_semi").select(
        "key", "seq", "op", "bad", *[x for i in range(len(refs)) for x in (f"set{i}", ok[i], f"end{i}")])
        .withColumn("__part", F.xxhash64("key")).repartition("__part")     # an exchange of its own: see billing
        .sortWithinPartitions("key", "seq", "op").drop("__part"))
    folded = cut_lineage(dealt.mapInArrow(
        _fold(len(refs), tuple(r.on_delete == "cascade" for r in refs), [f"FK:{r.column}" for r in refs]),
        "key bigint, kind string, a bigint, b bigint, nulled int, why string"))
    no = folded.where("kind = 'no'").select("key", F.col("a").alias("seq"), "why")
    end = folded.where("kind = 'end'").select("key", F.col("a").alias("start"), "nulled")
    spans = folded.where("kind = 'life'").select("key", "a", "b")
    gone = touched.join(spans.select("key"), "key", "left_anti").select("key", F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"))

    # the final life's first values: the old row, or the insert it began with; then the latest update of every column
    begun = end.where(F.col("start") != BEFORE)
    from_insert = inserts.join(begun, (inserts[key] == begun["key"]) & (inserts["seq"] == begun["start"])).select(
        *spec.names, "start", "nulled")
    from_base = base.join(end.where(F.col("start") == BEFORE), F.col(key) == F.col("key")).select(*spec.names, "start", "nulled")
    rows = from_insert.unionByName(from_base)
    live = bad_update.where("bad is null").join(end.select(F.col("key").alias("__k"), "start"), (F.col(key) == F.col("__k")) & (F.col("seq") > F.col("start")))
    live = live.join(no.select(F.col("key").alias("__n"), F.col("seq").alias("__s")), (F.col(key) == F.col("__n")) & (F.col("seq") == F.col("__s")), "left_anti")
    last = live.groupBy(F.col(key).alias("__u")).agg(*[
        F.max(F.when(F.array_contains("fields", c), F.struct("seq", F.struct(c).alias("v")))).alias(f"__{c}") for c in carried]) if carried else None
    if last is not None:
        rows = rows.join(last, F.col(key) == F.col("__u"), "left")
        rows = rows.select(key, *[F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.v.{c}")).otherwise(F.col(c)).alias(c) if c in carried
                                  else F.col(c) for c in names], "nulled")
    for i, r in enumerate(refs):
        if r.on_delete != "cascade":
            rows = rows.withColumn(r.column, F.when(F.col("nulled").bitwiseAND(1 << i) == 0, F.col(r.column)))
    untouched = base.join(touched, F.col(key) == F.col("key"), "left_anti")
    result = untouched.select(*spec.names).unionByName(rows.select(*spec.names))
    refused = no.where("why is not null").select(F.lit(spec.name).alias("table_name"), F.col("key").alias("row_key"), "seq", F.col("why").alias("reason"))
    refused = refused.unionByName(unusable.select(F.lit(spec.name).alias("table_name"), F.col(key).alias("row_key"), "seq", F.lit("NO_KEY").alias("reason")))
    return result, cut_lineage(spans.unionByName(gone)), refused
