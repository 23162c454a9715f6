"""Who takes a key: of rows that want the same keys, in order, and of updates that pass keys on.

* :func:`accepted_in_order` — inserts one after the other: a row is accepted when none of its keys is held by
  an earlier accepted row.
* :func:`passed_on` — updates of one batch taken as a set: a row may take a key whose holder gives it up in the
  same batch, so two rows can swap.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.lineage import Rounds
from ..session import ship_package

FREE, BLOCKED, OPEN = 1, 2, 0


def accepted_in_order(rows: DataFrame, keysets: list[tuple[list[str], str]]) -> tuple[DataFrame, dict[str, int]]:
    """``rid, why`` of every refused row: the label of each key that an earlier accepted row holds; and the rounds taken.

    ``rows``: ``rid`` (bigint, unique), ``o`` (the order, unique) and the key columns; a NULL part meets nothing.
    Only keys that several rows share matter.  First the rows that are first under all their keys are accepted, and
    what shares a key with them refused; a batch without chains is decided then.  What is left is cut into components
    that share no key, and every component is decided in order by a streamed fold that holds the keys taken in it.
    """
    tables = Rounds(rows, "conflicts")
    marked, parts = rows.select("rid", "o", *{c: None for on, _ in keysets for c in on}), []
    for i, (on, _) in enumerate(keysets):
        shared = (rows.dropna(subset=on).groupBy(*on).agg(F.min("rid").alias(f"g{i}"), F.count(F.lit(1)).alias("n"))
                  .where("n > 1").drop("n"))
        marked = marked.join(shared, on, "left")
        parts.append(f"g{i}")
    # a shared key is named by its smallest row id: one number, whatever its columns
    marked = tables.write(marked.where(F.coalesce(*parts).isNotNull()).select("rid", "o", *parts))
    done = {"rounds": 1, "component_rounds": 0}
    x = marked
    won = F.lit(True)
    for g in parts:
        least = marked.where(F.col(g).isNotNull()).groupBy(g).agg(F.min("o").alias(f"f_{g}"))
        x = x.join(least, g, "left")
        won &= F.coalesce(F.col(f"f_{g}") == F.col("o"), F.lit(True))
    x = tables.write(x.select("rid", "o", *parts, won.alias("won")))
    left = x.where(~F.col("won"))
    for g in parts:
        left = left.join(x.where(F.col("won") & F.col(g).isNotNull()).select(g), g, "left_anti")
    left = left.select("rid", "o", *parts)
    accepted = x.where("won").select("rid", "o", *parts)
    if not left.isEmpty():
        left = tables.write(left)
        folded, done["component_rounds"] = _fold_components(left, parts)
        accepted = tables.write(accepted.unionByName(left.join(folded, "rid", "left_semi")))
    lost = marked.join(accepted.select("rid"), "rid", "left_anti")
    found = []
    for g, (_, label) in zip(parts, keysets, strict=True):
        holder = accepted.where(F.col(g).isNotNull()).select(g, F.col("o").alias("holder"))       # one row a key
        found.append(lost.join(holder, g).where(F.col("holder") < F.col("o")).select("rid", F.lit(label).alias("why")))
    return reduce(DataFrame.unionByName, found), done


def _fold_components(rows: DataFrame, parts: list[str]) -> tuple[DataFrame, int]:
    """``rid`` of the rows accepted when every component is taken in order."""
    links = []
    for g in parts:
        least = rows.where(F.col(g).isNotNull()).groupBy(g).agg(F.min("rid").alias("b"))
        links.append(rows.where(F.col(g).isNotNull()).join(least, g).select(F.col("rid").alias("a"), "b"))
    roots, rounds = components(reduce(DataFrame.unionByName, links))
    ship_package(rows.sparkSession)
    dealt = (rows.join(roots, rows.rid == roots.node, "left")
             .select("rid", "o", *parts, F.coalesce("root", "rid").alias("root"))
             .repartition("root").sortWithinPartitions("root", "o").select("rid", "root", *parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, taken = None, [set() for _ in parts]
        for b in batches:
            won = []
            for rid, root, *keys in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if root != at:
                    at, taken = root, [set() for _ in parts]
                if all(k is None or k not in s for k, s in zip(keys, taken, strict=True)):
                    won.append(rid)
                    for k, s in zip(keys, taken, strict=True):
                        s.add(k)
            yield pa.RecordBatch.from_arrays([pa.array(won, pa.int64())], ["rid"])

    return dealt.mapInArrow(run, "rid bigint"), rounds


def passed_on(movers: DataFrame, holders: DataFrame) -> tuple[DataFrame, int]:
    """``id`` of the movers that do not get the key they want, and the rounds taken.

    ``movers``: ``id, o, want`` — rows that give up their key for another one (``want`` null: for none), in
    order ``o``; ``holders``: ``want, holder`` — who has the key now.  Of several movers that want one key the first
    gets it.  It needs the key's holder to give it up, who needs the holder of *its* key to, and so on: chains that end
    at a free key all move, chains that end at a row that stays do not, and rings move (a swap).  A key that
    several rows hold already is not given up.  Chains are followed by pointer doubling, so rounds grow with the logarithm
    of the longest.
    """
    first = movers.where(F.col("want").isNotNull()).groupBy("want").agg(F.min(F.struct("o", "id")).alias("f"))
    first = first.select("want", F.col("f.id").alias("id"))
    held = holders.join(first.select("want"), "want", "left_semi").groupBy("want").agg(
        F.min("holder").alias("next"), F.count(F.lit(1)).alias("n"))
    nodes = first.join(held, "want", "left").select(
        "id", "next", F.when(F.col("n").isNull(), FREE).when(F.col("n") > 1, BLOCKED).otherwise(OPEN).alias("state"))
    tables = Rounds(movers, "passed-on")
    nodes = tables.write(nodes.unionByName(movers.where(F.col("want").isNull()).select(
        "id", F.lit(None).cast(nodes.schema["next"].dataType).alias("next"), F.lit(FREE).alias("state"))))
    rounds, left = 0, nodes.where(F.col("state") == OPEN).count()
    while left:
        rounds += 1
        there = nodes.select(F.col("id").alias("t_id"), F.col("next").alias("t_next"), F.col("state").alias("t_state"))
        j = nodes.join(there, (F.col("state") == OPEN) & (F.col("next") == F.col("t_id")), "left")
        opened = F.col("state") == OPEN
        nodes = tables.write(j.select(
            "id", F.when(opened & (F.col("t_state") == OPEN), F.col("t_next")).otherwise(F.col("next")).alias("next"),
            F.when(~opened, F.col("state")).when(F.col("t_id").isNull(), BLOCKED).otherwise(F.col("t_state")).alias("state")))
        tables.keep(nodes)
        still = nodes.where(F.col("state") == OPEN).count()
        if still == left:                       # every round ends the nearest part of each chain: only rings are left
            break
        left = still
    gets = nodes.where(F.col("state") != BLOCKED).select("id")
    return movers.select("id").join(gets, "id", "left_anti"), rounds
