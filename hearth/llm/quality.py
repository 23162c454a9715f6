"""Quality rules with an isolation forest over the rules' statistics.

Every document gets whole-text statistics (the base rules' counts and rates).  An isolation forest
of ``TREES`` trees, each grown on ``SAMPLE`` documents, isolates anomalous ones by short paths over
random splits; the trees' sample is bounded (``TREES * SAMPLE`` documents, those of the smallest
hashes), the scoring covers all rows.  The threshold on the anomaly score is calibrated on all labelled
rows, counted by class and score: the score above which bad rows outweigh good ones most (Youden's index), good rows weighing
``GOOD_WEIGHT`` times.  Without labels of both classes nothing but the base rules rejects.

Defined results: null text has no words and fails the base rules; rows with an equal ``doc_id`` are
judged each on their own; a document labelled both ways counts for both; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged, texts

TREES, SAMPLE, SEED = 100, 256, 11
SCORE_STEPS = 1_000_000
GOOD_WEIGHT = 4.0

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate",
         "digit_rate", "punct_rate", "line_words", "top_rate")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SCHEMA = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) + ", " + ", ".join(f"{c} double" for c in RATES)


def _stats(text: str | None) -> tuple:
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(_SYMBOL.findall(text))
    seen, dup, full = set(), 0, 0
    for line in text.split("\n"):
        if _WORD.search(line):
            full += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat, distinct, top = 0, 1.0, 0.0
    if n:
        ids: dict[str, int] = {}
        a = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
        distinct, top = len(ids) / n, np.bincount(a).max() / n
        if n >= 3:
            two = a[:-1] * len(ids) + a[1:]
            _, two = np.unique(two[:-1], return_inverse=True)      # numbered anew: no overflow for long texts
            _, inv, cnt = np.unique(two * len(ids) + a[2:], return_inverse=True, return_counts=True)
            hit = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(cnt[inv] >= 2)
            np.add.at(hit, at, 1)
            np.add.at(hit, at + 3, -1)
            repeat = int((np.cumsum(hit)[:n] > 0).sum())
    letters = max(1, len(text))
    upper = sum(map(str.isupper, text)) / letters
    digits = sum(map(str.isdigit, text)) / letters
    punct = sum(text.count(c) for c in "!?.,;:") / letters
    return (n, chars, symbols, dup, repeat, chars / n if n else 0.0, symbols / letters, dup / full if full else 0.0,
            repeat / n if n else 0.0, distinct, upper, digits, punct, n / full if full else 0.0, float(top))


def statistics(docs: DataFrame) -> DataFrame:
    """One row of rule statistics per document."""
    names = ("doc_id", *BASE, *RATES)

    def one(b):
        rows = [_stats(t) for t in b.column(1).to_pylist()]
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * len(BASE) + [pa.float64()] * len(RATES)
        return pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], list(names))

    return map_batches(texts(docs), one, _SCHEMA)


def _matrix(table) -> np.ndarray:
    get = lambda c: np.asarray(table.column(c), dtype=float)
    return np.stack([np.log1p(get("n_words")), *[get(c) for c in RATES]], axis=1)


def grow(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Trees as arrays of (feature, split, left, right, path length so far at a leaf)."""
    forest, depth_most = [], int(np.ceil(np.log2(SAMPLE)))
    for _ in range(TREES):
        rows = x[rng.permutation(len(x))[:SAMPLE]]
        nodes: list[list[float]] = []

        def build(r, depth, nodes=nodes):
            me = len(nodes)
            nodes.append([-1, 0, 0, 0, depth + _average_path(len(r))])
            lo, hi = (r.min(0), r.max(0)) if len(r) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
            free = np.flatnonzero(hi > lo)
            if depth < depth_most and len(r) > 1 and len(free):
                f = int(rng.choice(free))
                s = rng.uniform(lo[f], hi[f])
                left = r[:, f] < s
                nodes[me][:2] = f, s
                nodes[me][2] = build(r[left], depth + 1)
                nodes[me][3] = build(r[~left], depth + 1)
            return me

        build(rows, 0)
        forest.append(np.array(nodes))
    return forest


def _average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` points."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def anomaly(x: np.ndarray, forest: list[np.ndarray]) -> np.ndarray:
    """2^(-mean path / expected path): near 1 is anomalous, under 0.5 ordinary."""
    path = np.zeros(len(x))
    for t in forest:
        at = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live):
            f = t[at[live], 0].astype(np.int64)
            live, f = live[f >= 0], f[f >= 0]
            if not len(live):
                break
            node = t[at[live]]
            at[live] = np.where(x[live, f] < node[:, 1], node[:, 2], node[:, 3]).astype(np.int64)
        path += t[at, 4]
    return 2.0 ** (-path / max(len(forest), 1) / _average_path(SAMPLE))


def fit(stats: DataFrame, labels: DataFrame) -> dict | None:
    """Forest and threshold; ``None`` when there is no row or no label of either class."""
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED))
    table = stats.orderBy(h, "doc_id", *BASE).limit(TREES * SAMPLE).toArrow()
    if not table.num_rows:
        return None
    forest = grow(_matrix(table), np.random.default_rng(SEED))
    lab = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
           .where(F.col("quality").isin(0, 1)).distinct())
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def one(b):
        return pa.RecordBatch.from_arrays([b.column("quality"), pa.array(anomaly(_matrix(b), shared.value))], ["quality", "score"])

    scored = map_batches(stats.join(lab, "doc_id"), one, "quality int, score double")
    # a threshold lies between two scores: those of a step of 10^-6 count as one, so at most 10^6 rows come back
    step = F.floor(F.col("score") * SCORE_STEPS).alias("step")
    got = (scored.groupBy(step).agg(F.sum((F.col("quality") == 0).cast("bigint")).alias("bad"), F.sum((F.col("quality") == 1).cast("bigint")).alias("good"),
                                    F.min("score").alias("low"), F.max("score").alias("high")).orderBy(F.desc("step")).toArrow())
    bad, good, low, high = (np.asarray(got.column(c), dtype=float) for c in ("bad", "good", "low", "high"))
    if not len(bad) or not bad.sum() or not good.sum():
        return None
    gain = np.cumsum(bad) / bad.sum() - GOOD_WEIGHT * np.cumsum(good) / good.sum()
    best = int(np.argmax(gain))
    threshold = float((low[best] + high[best + 1]) / 2) if gain[best] > 0 and best + 1 < len(low) else 1.1
    return {"forest": forest, "threshold": threshold}


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and the anomaly score of every document."""
    stats = staged(statistics(docs), "quality-stats")
    model = fit(stats, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", *BASE, "base_failed", "kept", "anomaly"]

    def one(b):
        m = shared.value
        n, rep = np.asarray(b.column("n_words")), np.asarray(b.column("n_repeat_words"))
        failed = (n < 50) | (100 * rep > 50 * n)
        s = anomaly(_matrix(b), m["forest"]) if m else np.zeros(len(n))
        kept = ~failed & (s <= m["threshold"]) if m else ~failed
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(c) for c in BASE],
                                           pa.array(failed), pa.array(kept), pa.array(s)], names)

    return map_batches(stats, one, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in BASE) +
                       ", base_failed boolean, kept boolean, anomaly double")
