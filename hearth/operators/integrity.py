"""Declarative integrity as data-quality jobs.

Each rule returns the violating rows (or a count per column), never an
error.  All rules are driven by the declared schema in :mod:`hearth.schemas`
and read every table whole; each rule on each table is one Spark SQL
statement over the table's DataFrame (``spark.sql(text, t=df)``), but for I1,
which counts the keys of all tables at once.
Group-based rules aggregate partially before their shuffle, so a key held by
a third of all rows costs one partial row per map task; a reference check is
one anti join, whose child side AQE splits where a foreign key is hot.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import schemas as S
from ..sources.derived import LazyTables, tasks_for

# Case-, accent- and trailing-space-insensitive comparison, as the reference's collation.
COLLATION = "UNICODE_CI_AI_RTRIM"
KEYS_A_TASK = 1_000_000        # keys that one task counts, about


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _sql(df: DataFrame, text: str, **frames) -> DataFrame:
    return df.sparkSession.sql(text, t=df, **frames)


def counted(keys: DataFrame, rows: int | None) -> DataFrame:
    """The keys with ``m``, how many rows hold them: one row for a key in each Arrow batch, dealt to as many tasks as
    ``rows`` ask for (None: Spark's choice)."""
    names = keys.columns

    def count(batches):
        for b in batches:
            c = pa.Table.from_batches([b]).group_by(names).aggregate([([], "count_all")])
            yield from c.select([*names, "count_all"]).rename_columns([*names, "m"]).to_batches()

    tasks = [] if rows is None else [tasks_for(rows, KEYS_A_TASK)]
    types = [f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields]
    return keys.mapInArrow(count, ", ".join([*types, "m bigint"])).repartition(*tasks, *names)


def pk_duplicates(t) -> DataFrame:
    """(table_name, key_value, n) for keys held by more than one row, or null keys.

    The keys of all tables are counted in one grouping: a grouping per table under one union may run side by side in
    the same task, which then holds the groups of every table.  Each Arrow batch counts its keys before the shuffle, so
    a key that very many rows hold costs one row a batch; the shuffle deals the counts to as many tasks as the rows ask
    for (Spark's choice, where the tables do not know their size).
    """
    names = list(S.TABLES)
    keys = _union([_sql(t[n], f"SELECT {i} AS at, CAST({S.TABLES[n].key} AS BIGINT) AS key_value FROM {{t}}") for i, n in enumerate(names)])
    counts = counted(keys, t.rows() if isinstance(t, LazyTables) else None)
    return _sql(counts, f"""
        SELECT element_at(array({", ".join(repr(n) for n in names)}), at + 1) AS table_name, key_value, sum(m) AS n FROM {{t}}
        GROUP BY at, key_value HAVING sum(m) > 1 OR key_value IS NULL""")


def unique_violations(t) -> DataFrame:
    """(table_name, constraint_name, key_text, n) for unique keys held twice under the collation.

    Text parts are grouped on their collated form; ``key_text`` shows the
    smallest original spelling, so the output is deterministic.  Rows with a
    NULL key part never collide (SQL UNIQUE semantics).
    """
    parts = []
    for n, s in S.TABLES.items():
        for cols in s.uniques:
            text = [c for c in cols if s.column(c).dtype == "string"]
            group = ", ".join(f"collate({c}, '{COLLATION}')" if c in text else c for c in cols)
            shown = ", ".join(f"min({c})" if c in text else f"CAST({c} AS STRING)" for c in cols)
            present = " AND ".join(f"{c} IS NOT NULL" for c in cols)
            parts.append(_sql(t[n], f"""
                SELECT '{n}' AS table_name, '{",".join(cols)}' AS constraint_name,
                       concat_ws('|', {shown}) AS key_text, count(*) AS n
                FROM {{t}} WHERE {present} GROUP BY {group} HAVING count(*) > 1"""))
    return _union(parts)


def fk_orphans(t) -> DataFrame:
    """(table_name, column_name, row_key, ref_value) for references to a missing parent (null allowed)."""
    parts = []
    for n, s in S.TABLES.items():
        for r in s.refs:
            parts.append(_sql(t[n], f"""
                SELECT '{n}' AS table_name, '{r.column}' AS column_name, {s.key} AS row_key,
                       {r.column} AS ref_value
                FROM {{t}} c LEFT ANTI JOIN {{p}} p ON c.{r.column} = p.{r.parent_key}
                WHERE {r.column} IS NOT NULL""", p=t[r.parent]))
    return _union(parts)


def _per_column_counts(t, pick, cond, out_name: str) -> DataFrame:
    """One aggregate pass per table giving one count per chosen column, kept where > 0."""
    parts = []
    for n, s in S.TABLES.items():
        cols = [c for c in s.columns if pick(c)]
        if not cols:
            continue
        counts = ", ".join(f"CAST(count_if({cond(c)}) AS BIGINT) AS c{i}" for i, c in enumerate(cols))
        pairs = ", ".join(f"'{c.name}', c{i}" for i, c in enumerate(cols))
        parts.append(_sql(t[n], f"""
            SELECT '{n}' AS table_name, column_name, {out_name} FROM (
              SELECT stack({len(cols)}, {pairs}) AS (column_name, {out_name}) FROM (SELECT {counts} FROM {{t}}) a
            ) x WHERE {out_name} > 0"""))
    return _union(parts)


def null_violations(t) -> DataFrame:
    """I4: (table_name, column_name, null_rows) for NOT NULL columns holding nulls."""
    return _per_column_counts(t, lambda c: not c.nullable, lambda c: f"{c.name} IS NULL", "null_rows")


def length_violations(t) -> DataFrame:
    """I8: (table_name, column_name, too_long) for text longer than its declared VARCHAR length."""
    return _per_column_counts(t, lambda c: c.length is not None,
                              lambda c: f"char_length({c.name}) > {c.length}", "too_long")


def check_violations(t) -> DataFrame:
    """(table_name, rule_name, row_key) for rows whose CHECK is false (unknown passes, as in SQL)."""
    return _union([_sql(t[n], f"SELECT '{n}' AS table_name, '{rule}' AS rule_name, {s.key} AS row_key "
                              f"FROM {{t}} WHERE NOT ({cond})")
                   for n, s in S.TABLES.items() for rule, cond in s.checks])


def enum_violations(t) -> DataFrame:
    """(table_name, column_name, row_key, value) for values outside the declared domain.

    One scan per table: the enum columns are unpivoted with ``stack`` and each
    value is tested against its own column's domain.
    """
    parts = []
    for n, s in S.TABLES.items():
        cols = [c for c in s.columns if c.domain]
        if not cols:
            continue
        pairs = ", ".join(f"'{c.name}', {c.name}" for c in cols)
        test = " ".join(f"WHEN '{c.name}' THEN value NOT IN ({', '.join(repr(v) for v in c.domain)})" for c in cols)
        parts.append(_sql(t[n], f"""
            SELECT '{n}' AS table_name, column_name, row_key, value FROM (
              SELECT {s.key} AS row_key, stack({len(cols)}, {pairs}) AS (column_name, value) FROM {{t}}) x
            WHERE CASE column_name {test} END"""))
    return _union(parts)


def duplicate_bills(t) -> DataFrame:
    """(resident_id, category_id, fee_period, n) for more than one bill of a resident, category and period."""
    return _sql(t["fee_records"], """
        SELECT resident_id, category_id, fee_period, count(*) AS n FROM {t}
        GROUP BY resident_id, category_id, fee_period HAVING count(*) > 1""")
