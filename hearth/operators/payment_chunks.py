"""The payment fold of bills with very many payments, cut into chunks that are walked in parallel.

Posting takes a payment when it fits into what is left of the bill (``r`` cents).  While r stays in [2^c, 2^(c+1)),
payments of at most 2^c always fit, those of 2^(c+1) and more never do, and one in between ends the phase if it
fits, as r then falls under 2^c.  So a chunk of payments is summarised per c by the sum of its small ones and by the
least (payment + small ones before it) among those in between: with both, whoever enters the chunk with r knows
whether the phase ends inside, and if not, what is left after it.  Summaries are put together in order; only a chunk in
which a phase ends is walked itself, and a bill has no more phases than its amount has bits.  Then all chunks are posted
at once, each from the r it is entered with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Rounds
from ..session import ship_package

HOT_PAYMENTS = 2_000_000       # a bill with more payments than this in one batch is posted in chunks
CHUNK_ROWS = 250_000
BITS = 44                      # amounts are decimal(10,2), sums of them in cents stay far below 2^44
ORDER = ("seq", "amt_null", "amt_c")


def hot_bills(payments: DataFrame) -> tuple[DataFrame | None, int]:
    """``fee_id`` of the bills with more than ``HOT_PAYMENTS`` payments (None: there are none) and their payments' number."""
    counts = payments.groupBy("fee_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_PAYMENTS)
    counts = Rounds(payments, "hot-bills").write(counts)
    rows = counts.agg(F.sum("n")).first()[0]
    return (counts.select("fee_id"), rows) if rows else (None, 0)


def _table(b: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
                      if isinstance(b, pa.RecordBatch) else b.column(name).to_numpy())


def walk(r: int, x: np.ndarray) -> np.ndarray:
    """Which of the payments ``x`` (cents; not positive: none) fit, one after the other, into ``r``."""
    taken = np.zeros(len(x), bool)
    at = 0
    while r > 0 and at < len(x):
        c = int(r).bit_length() - 1
        rest = x[at:]
        small = (rest > 0) & (rest <= 1 << c)
        part = np.where(small, rest, 0)
        upto = np.cumsum(part)
        # the phase ends at the first payment between that fits, or with the small one that takes r under 2^c
        ends = ((rest > 1 << c) & (rest + upto <= r)) | (r - upto < 1 << c)
        if not ends.any():
            taken[at:] = small
            break
        stop = int(ends.argmax())
        taken[at:at + stop] = small[:stop]
        taken[at + stop] = True
        r -= int(x[at:at + stop + 1][taken[at:at + stop + 1]].sum())
        at += stop + 1
    return taken


def summarise(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Per c: the sum of payments of at most 2^c, and the least (payment + small ones before it) in between (-1: none)."""
    sums, least = [], []
    for c in range(BITS):
        small = (x > 0) & (x <= 1 << c)
        part = np.where(small, x, 0)
        before = np.cumsum(part) - part
        between = (x > 1 << c) & (x < 2 << c)
        sums.append(int(part.sum()))
        least.append(int((x + before)[between].min()) if between.any() else -1)
    return sums, least


def after(r: int, sums: list[int], least: list[int]) -> int | None:
    """What is left after a chunk entered with ``r``, or None where a phase ends inside."""
    if r <= 0:
        return r
    c = r.bit_length() - 1
    if sums[c] > r - (1 << c) or 0 <= least[c] <= r:
        return None
    return r - sums[c]


def _payments(g: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A chunk in order, and its payments in cents (null: 0)."""
    g = g.sort_by([(c, "ascending") for c in ORDER])
    return g, np.where(_table(g, "amt_null").astype(bool), 0, _table(g, "amt_c"))


class Chunks:
    """The payments of hot bills, cut into chunks, and what every chunk is entered with."""

    def __init__(self, joined: DataFrame, seqs: DataFrame, rows: int):
        """``joined``: the hot bills' payments with their bill's state and ``early`` (refused whatever came before);
        ``seqs``: these payments' ``seq``, whose quantiles cut the chunks, and their number.  A bill with its share
        of the payments has that share of the chunks; payments of a bill with equal ``seq`` stay in one."""
        ship_package(joined.sparkSession)
        self.tables = Rounds(joined, "payment-chunks")
        n = -(-rows // CHUNK_ROWS)
        cuts = seqs.agg(F.percentile_approx(F.col("seq").try_cast("int"), [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else None
        cuts = sorted(set(cuts or []))
        chunk = F.size(F.filter(F.lit(cuts).cast("array<int>"), lambda c: c < F.col("seq"))) if cuts else F.lit(0)
        written = self.tables.write(joined.withColumn("chunk", chunk))
        self.early, self.rows = written.where("early is not null").drop("chunk"), written.where("early is null").drop("early")
        summary = self.tables.write(self.rows.groupBy("fee_id", "chunk").applyInArrow(
            self._summary, "fee_id bigint, chunk int, room bigint, sums array<bigint>, least array<bigint>"))
        exits = None
        self.rounds = 0
        while True:
            self.rounds += 1
            known = summary.withColumn("exit", F.lit(None).cast("bigint")) if exits is None else summary.join(
                exits, ["fee_id", "chunk"], "left")
            ordered = (known.withColumn("__part", F.xxhash64("fee_id")).repartition("__part")
                       .sortWithinPartitions("fee_id", "chunk").select("fee_id", "chunk", "room", "sums", "least", "exit"))
            self.entries = self.tables.write(ordered.mapInArrow(
                self._compose, "fee_id bigint, chunk int, kind string, first bigint, r bigint"))
            open_ = self.entries.where("kind = 'open'").select("fee_id", "chunk", "r")
            if open_.isEmpty():
                break
            walked = self.rows.select("fee_id", "chunk", *ORDER).join(open_, ["fee_id", "chunk"]).groupBy("fee_id", "chunk").applyInArrow(
                self._exit, "fee_id bigint, chunk int, exit bigint")
            exits = self.tables.write(walked if exits is None else walked.unionByName(exits))

    @staticmethod
    def _summary(g: pa.Table) -> pa.Table:
        g, x = _payments(g)
        sums, least = summarise(x)
        room = int(_table(g, "amount_c")[0]) - int(_table(g, "paid0_c")[0])
        return pa.table({"fee_id": g.column("fee_id")[:1], "chunk": g.column("chunk")[:1], "room": pa.array([room], pa.int64()),
                         "sums": pa.array([sums], pa.list_(pa.int64())), "least": pa.array([least], pa.list_(pa.int64()))})

    @staticmethod
    def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per bill, in order: what each chunk is entered with ('in'), the first one to be walked ('open'), the end ('out')."""
        fee, first, r, stuck = None, 0, 0, False

        def batch(rows):
            c = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], ["fee_id", "chunk", "kind", "first", "r"])

        for b in batches:
            out = []
            for f, chunk, room, sums, least, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if f != fee:
                    if fee is not None and not stuck:
                        out.append((fee, -1, "out", first, r))
                    fee, first, r, stuck = f, room, room, False
                if stuck:
                    continue
                out.append((f, chunk, "in", first, r))
                then = after(r, sums, least)
                if then is None and known is None:
                    out.append((f, chunk, "open", first, r))
                    stuck = True
                else:
                    r = known if then is None else then
            yield batch(out)
        if fee is not None and not stuck:
            yield batch([(fee, -1, "out", first, r)])

    @staticmethod
    def _exit(g: pa.Table) -> pa.Table:
        g, x = _payments(g)
        r = int(_table(g, "r")[0])
        return pa.table({"fee_id": g.column("fee_id")[:1], "chunk": g.column("chunk")[:1],
                         "exit": pa.array([r - int(x[walk(r, x)].sum())], pa.int64())})

    def outcomes(self, columns: str, codes: dict[str, int]) -> DataFrame:
        """One row per payment, in the fold's columns; ``codes`` numbers its reasons and states."""
        def post(g: pa.Table) -> pa.Table:
            g, x = _payments(g)
            r, first, amount = (int(_table(g, c)[0]) for c in ("r", "first", "amount_c"))
            taken = walk(r, x)
            left = r - np.cumsum(np.where(taken, x, 0))
            before = left + np.where(taken, x, 0)
            closed = (before == 0) & (first > 0)
            reason = np.where(closed, codes["closed"], np.where(x <= 0, codes["none"], np.where(taken, codes["ok"], codes["over"])))
            code = np.where(left == first, codes["keep"], np.where(left == 0, codes["paid"], codes["part"]))
            keep = {c: g.column(c) for c in ("fee_id", "seq", "amt_c", "amt_null", "status0_i", "status0_x")}
            return pa.table(keep | {"reason": pa.array(reason, pa.int32()), "paid_c": pa.array(amount - left, pa.int64()),
                                    "code": pa.array(code, pa.int32())})

        entered = self.entries.where("kind = 'in'").select("fee_id", "chunk", "first", "r")
        return self.rows.join(entered, ["fee_id", "chunk"]).groupBy("fee_id", "chunk").applyInArrow(post, columns)

    def finals(self, codes: dict[str, int]) -> DataFrame:
        """One row per bill: its state after the batch."""
        room = self.rows.groupBy("fee_id").agg(F.max("amount_c").alias("amount_c"))
        end = self.entries.where("kind = 'out'").join(room, "fee_id")
        paid = (F.col("r") == 0) & (F.col("first") > 0)
        return end.select("fee_id", (F.col("amount_c") - F.col("r")).alias("paid_c"),
                          F.when(F.col("r") == F.col("first"), codes["keep"]).when(paid, codes["paid"]).otherwise(codes["part"]).alias("code"),
                          paid.alias("fired"))
