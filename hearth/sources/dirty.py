"""A dirtied copy of the estate tables, to give the integrity rules something to find.

Every table is unioned with a *twin* of each of its rows; the twin's key
decides (``key % 4``) which damage it carries, so the damage covers the
whole table:

* 0 — the same key and values: duplicate primary and unique keys;
* 1 — a new key, references pointing nowhere: orphans;
* 2 — a new key, unique text re-spelled (lower case, trailing space): a
  duplicate under the collation; enum values out of domain; CHECK columns 0;
  other limited text one character too long;
* 3 — a new key, NOT NULL columns null.

:func:`twin_sql` writes the same twin for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import schemas as S
from .derived import LazyTables

OFFSET = 1_000_000_000_000


def _roles(spec: S.Table):
    fks = {r.column for r in spec.refs}
    uniq_text = {c for cols in spec.uniques for c in cols if spec.column(c).dtype == "string"}
    checks = {cond.split(" ")[0] for _, cond in spec.checks}
    return fks, uniq_text, checks


def twin(df: DataFrame, table: str) -> DataFrame:
    """The damaged twin rows of ``table``: one SQL expression per column, one ``selectExpr``."""
    return df.selectExpr(*twin_exprs(table, "spark"))


def dirty_estate(t) -> LazyTables:
    """Every estate table unioned with its damaged twin (lazy)."""
    def build(n):
        return lambda: t[n].select(*S.TABLES[n].names).unionByName(twin(t[n], n))

    def rows():
        clean = t.rows() if isinstance(t, LazyTables) else None
        return None if clean is None else 2 * clean

    return LazyTables({n: build(n) for n in S.TABLES}, rows)


def twin_exprs(table: str, dialect: str) -> list[str]:
    """Column expressions of the twin, for Spark SQL (``dialect='spark'``) or DuckDB."""
    spec = S.TABLES[table]
    fks, uniq_text, checks = _roles(spec)
    typ_of = (lambda c: c.dtype) if dialect == "spark" else (lambda c: S.duck_type(c.dtype))
    text = "string" if dialect == "spark" else "VARCHAR"
    j = f"({spec.key} % 4)"
    out = []
    for c in spec.columns:
        typ = typ_of(c)
        n = c.name
        if n == spec.key:
            out.append(f"CASE WHEN {j} = 0 THEN {n} ELSE {n} + {OFFSET} END AS {n}")
            continue
        if n in fks:
            v = f"CASE WHEN {j} = 1 THEN {n} + {OFFSET} ELSE {n} END"
        elif n in uniq_text:
            v = (f"CASE WHEN {j} = 2 THEN lower({n}) || ' ' WHEN {j} = 0 THEN {n} "
                 f"ELSE {n} || '~' || CAST({j} AS {text}) END")
        elif c.domain:
            v = f"CASE WHEN {j} = 2 THEN '?' ELSE {n} END"
        elif n in checks:
            v = f"CASE WHEN {j} = 2 THEN CAST(0 AS {typ}) ELSE {n} END"
        elif c.length is not None:
            v = f"CASE WHEN {j} = 2 THEN repeat('x', {c.length + 1}) ELSE {n} END"
        else:
            v = n
        if not c.nullable:
            v = f"CASE WHEN {j} = 3 THEN NULL ELSE {v} END"
        out.append(f"CAST({v} AS {typ}) AS {n}")
    return out


def twin_sql(table: str) -> str:
    """DuckDB ``SELECT`` of the twin rows of ``table`` (from the CTE of the same name)."""
    return f"SELECT {', '.join(twin_exprs(table, 'duckdb'))} FROM {table}"
