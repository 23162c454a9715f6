"""Ranked lexical search in norm buckets: every document against every item, whole results.

A document is a vector of saturated term frequencies over the items' terms, an item one of term weights; the score
is their inner product in 64-bit integers.  Both are scaled by the square root of the term's weight, so that neither
side's length is ruled by terms the other can ignore.  Documents are ordered by length and taken in buckets: an
item whose length times the bucket's greatest length is under its current 10th score skips the bucket
(Cauchy-Schwarz).  Inside, its strongest coordinates (``FOCUS`` of its squared length) are multiplied out, the
others bounded by what both lengths have left; documents whose bound reaches the 10th score are scored again exactly.

Spark deals out the documents; each task orders and searches its own, from the 10th scores that the documents with the
greatest lengths (``FIRST``, a bounded first bucket) give, and hands on at most ``k`` rows an item.  Items are
taken in blocks of ``BLOCK_BYTES`` of text, so what goes to the tasks is bounded; equal texts are one query.

Defined results: null text has no terms; an item without a term, or one no document shares a term with, has no rows;
rows with equal ``doc_id`` or ``item_id`` each rank on their own (null ids last among equal scores); a text of any length
is counted in parts; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import WORD_TABLE, staged, texts, words
from .wordwise import numbered, pieces_of, ragged

BLOCK_BYTES = 4 << 20
PART_BYTES = 4 << 20
FIRST = 4096
BUCKET = 2048
FOCUS = 0.75


@dataclass
class Queries:
    """A block of items as sparse vectors: terms by number, their repeats."""

    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def queries(item_texts: list[str | None]) -> Queries:
    vocabulary: dict[bytes, int] = {}
    terms, repeats = [], []
    for t in item_texts:
        k, n = np.unique(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t)], np.int64), return_counts=True)
        terms.append(k)
        repeats.append(n.astype(np.int64))
    return Queries(vocabulary, terms, repeats)


def _parts(data: bytes):
    """A text's words in parts of about ``PART_BYTES``, cut at blanks."""
    start = 0
    while len(data) - start > PART_BYTES:
        cut = data.find(b" ", start + PART_BYTES)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut + 1
    yield data[start:]


def _count(data: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row its number of words; and (row << 32 | term) with its occurrences, for the vocabulary's terms."""
    split = pc.split_pattern(pa.array(data, pa.large_binary()), b" ")
    distinct, index = numbered(split.flatten())
    number = np.array([vocabulary.get(w, -1) if w else -2 for w in distinct], np.int64)[index]
    off = np.asarray(split.offsets)
    row = np.repeat(np.arange(len(data)), np.diff(off))
    n = np.bincount(row[number != -2], minlength=len(data))
    known = number >= 0
    return n, *np.unique(row[known] << 32 | number[known], return_counts=True)


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n`` (words of the text) and its ``terms`` of the vocabulary with their ``freqs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for b in batches:
            col = b.column(1)
            for s, e in pieces_of(col, PART_BYTES):
                data = [(t or "").encode().translate(WORD_TABLE) for t in col.slice(s, e - s).to_pylist()]
                if e - s > 1 or len(data[0]) <= 2 * PART_BYTES:
                    n, key, freq = _count(data, shared.value)
                else:                                            # one long text
                    each = [_count([p], shared.value) for p in _parts(data[0])]
                    n = np.array([sum(int(x[0][0]) for x in each)])
                    key, back = np.unique(np.concatenate([x[1] for x in each]), return_inverse=True)
                    freq = np.zeros(len(key), np.int64)
                    np.add.at(freq, back, np.concatenate([x[2] for x in each]))
                off = pa.array(np.searchsorted(key >> 32, np.arange(e - s + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s, e - s), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(off, pa.array((key & 0xFFFFFFFF).astype(np.int32))),
                     pa.ListArray.from_arrays(off, pa.array(freq, pa.int64()))], ["doc_id", "n", "terms", "freqs"])

    ship_package(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, freqs array<bigint>")


@dataclass
class Search:
    """One block of items ready to meet documents; ``floor`` has a score each item's k-th best is known to reach."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]              # repeats x weight, 64-bit
    length: np.ndarray
    focus: list[int]                       # so many of the terms, the strongest first, are multiplied out
    rest: np.ndarray                       # length of the others
    weight: np.ndarray                     # by term number
    documents: int
    occurrences: int
    floor: np.ndarray

    @classmethod
    def of(cls, q: Queries, df: dict[int, int], documents: int, occurrences: int) -> Search:
        weight = np.zeros(len(q.vocabulary), np.int64)
        for t, n in df.items():
            weight[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))
        terms, weights, length, focus, rest = [], [], [], [], []
        for t, r in zip(q.terms, q.repeats, strict=True):
            t, r = t[weight[t] > 0], r[weight[t] > 0]
            square = r.astype(float) ** 2 * weight[t]
            order = np.argsort(-square, kind="stable")
            terms.append(t[order])
            weights.append((r * weight[t])[order])
            upto = np.cumsum(square[order])
            total = float(upto[-1]) if len(upto) else 0.0
            k = min(len(upto), int(np.searchsorted(upto, FOCUS * total)) + 1)
            length.append(math.sqrt(total))
            focus.append(k)
            rest.append(math.sqrt(max(0.0, float(square[order][k:].sum()))))
        return cls(terms, weights, np.array(length), focus, np.array(rest), weight, documents, occurrences,
                   np.ones(len(terms), np.int64))

    def vectors(self, n: list[int], off: np.ndarray, term: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Saturated frequencies (integers) of the entries, and each document's squared length."""
        m = np.array([25 + 75 * x * self.documents // self.occurrences for x in n], np.int64)
        c = 1_000_000_000 * freq // (1000 * freq + 8 * np.repeat(m, np.diff(off)))
        square = np.concatenate([[0.0], np.cumsum(self.weight[term] * c.astype(float) ** 2)])
        slack = 1e-12 * square[-1]                               # what the running sum may have lost
        return c, (square[off[1:]] - square[off[:-1]]) + slack

    def run(self, batches, k: int):
        """Best ``k`` rows an item, as (query, doc_id or None, score); ``batches`` give doc_id, n, terms, freqs."""
        best: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 3 for _ in self.terms]      # score, id is null, id
        floor = self.floor.copy()
        dense = np.zeros(len(self.weight), np.int64)
        for b in batches:
            ids = b.column(0)
            null = np.asarray(pc.is_null(ids)).astype(np.int64)
            ids = np.asarray(pc.fill_null(ids, 0))
            lists = b.column(2)
            off = np.asarray(lists.offsets).astype(np.int64)
            off = off - off[0]
            term, freq = np.asarray(lists.flatten()).astype(np.int64), np.asarray(b.column(3).flatten())
            c, square = self.vectors(b.column(1).to_pylist(), off, term, freq)
            order = np.argsort(-square, kind="stable")
            for s in range(0, len(order), BUCKET):
                rows = order[s:s + BUCKET]
                active = np.flatnonzero((self.length * math.sqrt(square[rows[0]]) * (1 + 1e-9) >= floor) & (self.length > 0))
                if not len(active):
                    break                                        # shorter buckets reach no k-th score either
                size = off[rows + 1] - off[rows]
                entry = ragged(off[rows], size)
                t, x = term[entry], c[entry]
                start = np.cumsum(size) - size
                by = np.argsort(t, kind="stable")
                row_of, at = np.repeat(np.arange(len(rows)), size)[by], np.searchsorted(t[by], np.arange(len(dense) + 1))
                listed = x[by].astype(float)
                for q in active.tolist():
                    near = self._bounded(q, floor[q], at, row_of, listed, square[rows])
                    if not len(near):
                        continue
                    dense[self.terms[q]] = self.weights[q]
                    pos = ragged(start[near], size[near])
                    upto = np.concatenate([[0], np.cumsum(dense[t[pos]] * x[pos])])
                    dense[self.terms[q]] = 0
                    ends = np.cumsum(size[near])
                    score = upto[ends] - upto[ends - size[near]]
                    ok = score >= floor[q]
                    if ok.any():
                        d = rows[near[ok]]
                        have = [np.concatenate(z) for z in zip(best[q], (score[ok], null[d], ids[d]), strict=True)]
                        first = np.lexsort((have[2], have[1], -have[0]))[:k]
                        best[q] = [z[first] for z in have]
                        if len(first) == k:
                            floor[q] = max(floor[q], best[q][0][-1])
        for q, (score, none, doc) in enumerate(best):
            for x, y, z in zip(score.tolist(), none.tolist(), doc.tolist(), strict=True):
                yield q, None if y else z, x

    def _bounded(self, q: int, floor: int, at: np.ndarray, row_of: np.ndarray, listed: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Rows of the bucket whose bound (strong coordinates exactly, the others by lengths) reaches ``floor``."""
        k = self.focus[q]
        t, w = self.terms[q][:k], self.weights[q][:k]
        size = at[t + 1] - at[t]
        pos = ragged(at[t], size)
        row, x = row_of[pos], listed[pos]
        got = np.bincount(row, np.repeat(w.astype(float), size) * x, len(square))
        used = np.bincount(row, np.repeat(self.weight[t].astype(float), size) * x * x, len(square))
        bound = got + self.rest[q] * np.sqrt(np.maximum(0.0, square - used))
        return np.flatnonzero(bound * (1 + 1e-9) + 1 >= floor)


def _best(vectors: DataFrame, search: Search, k: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(search)

    def run(batches):
        rows = list(shared.value.run(batches, k))
        if rows:
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64())],
                                             ["query", "doc_id", "score"])

    return vectors.mapInArrow(run, "query int, doc_id bigint, score bigint")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block(docs: DataFrame, item_texts: list[str], k: int) -> DataFrame:
    """``text, rank, doc_id, score`` of one block of different item texts."""
    spark = docs.sparkSession
    q = queries(item_texts)
    vectors = staged(term_vectors(docs, q.vocabulary), "term-vectors")
    documents, occurrences = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(tuple(r) for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())   # the block's terms
    search = Search.of(q, df, documents, max(1, occurrences))
    met = vectors.where(F.size("terms") > 0)
    if documents:
        # about FIRST documents of the greatest lengths, were all frequencies one: they only set the scores to beat
        m = 25 + F.floor(F.lit(75.0) * F.col("n") * documents / occurrences)
        apart = 1 + F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << 20)) * 1e-12                   # equal ones are not all in or out
        length = F.size("terms") / F.pow(1000 + 8 * m, 2) * apart
        least = met.agg(F.percentile_approx(length, max(0.0, 1 - FIRST / documents), 100_000)).first()[0]
        first = met.where(length >= F.lit(least))
        top = staged(_ranked(_best(first, search, k), k), "first-bucket")
        for r in top.where(F.col("rank") == k).select("query", "score").collect():         # one row an item of the block
            search.floor[r[0]] = max(1, r[1])
    named = spark.createDataFrame(list(enumerate(item_texts)), "query int, text string")
    return _ranked(_best(met, search, k), k).join(named, "query").select("text", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int | None = None) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents."""
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    different = staged(items.select("text").distinct(), "item-texts")
    size = different.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // (block_bytes or BLOCK_BYTES)))
    numbered_ = different.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    found = []
    for n in range(blocks):
        part = [r[0] for r in numbered_.where(F.col("block") == n).orderBy("text").select("text").collect()]
        if part or (n == blocks - 1 and not found):
            found.append(staged(_block(docs, part, k), "ranked"))
    return (items.join(reduce(DataFrame.unionByName, found), "text")
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
