"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the letters of words, one for toxic and one for
ordinary text, differ in their higher orders and share the lowest ones: a rare expression
falls back on continuation counts that both classes feed.  Counting is a Spark aggregate over
every labelled document; each lower order is derived from the order above it as in Kneser-Ney
(types, not tokens).  The two models are folded into one table in back-off form,

    llr(h, c) = value(h, c)                      where the n-gram was seen in either class
              = backoff(h) + llr(shorter h, c)   elsewhere

and every n-gram and every context keeps its own entry, however rare: the table grows with the corpus'
distinct n-grams (16 bytes an entry, collected and broadcast).  Orders that the classes share have ratio 1 and no entries.

A document's score is a logistic of its length-normalised log-likelihood difference and of the
strongest words in it, fitted on a tenth of the labelled rows, but on about ``CALIBRATION_ROWS`` where that
is more; the counts see all others.

Defined results: null text is empty text; a text without words has both log-likelihoods 0 and
gets the score of the logistic at zero evidence; rows with an equal ``doc_id`` are scored each on
their own; a document labelled both ways counts for both classes; without labels of both classes
every score is 0.  Labels that are null or not 0/1 are ignored; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship_package
from .common import map_batches, slices, staged, texts

ORDER = 6                    # bytes in the longest n-gram, the word's start included
SHARED = 2                   # orders up to this one are pooled over both classes
DISCOUNT = 0.75
CALIBRATION_ROWS = 20_000    # expected size of the logistic's sample at most
TOP = 5                      # strongest words of a document that the logistic sees
FEATURES = 4

_SPLIT = re.compile(r"[\W\d_]+")
_COUNT_SCHEMA = "gram bigint, c1 bigint, c0 bigint"


def _tokens(text: str | None) -> list[str]:
    return [w for w in _SPLIT.split(text.lower()) if w] if text else []


def _grams(vocab: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every position's n-gram of ``ORDER`` bytes as one integer, and the index of its word.

    A word is led by ``ORDER - 1`` spaces and ended by one, so each byte and the end are predicted."""
    raw = [b" " * (ORDER - 1) + w.encode("utf-8", "surrogatepass") + b" " for w in vocab]
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    n = size - ORDER + 1
    word = np.repeat(np.arange(len(raw)), n)
    start = np.repeat(np.cumsum(size) - size, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    gram = np.zeros(len(start), np.int64)
    for k in range(ORDER):
        gram = (gram << 8) | buf[start + k]
    return gram, word


def _count_batches(batches):
    """Partial n-gram counts per class; word counts are merged first, so each word is cut up once."""
    seen: dict[str, list[int]] = {}

    def out():
        vocab = list(seen)
        gram, word = _grams(vocab)
        if not len(gram):
            return None
        c = np.array([seen[w] for w in vocab], np.int64)
        keys, inv = np.unique(gram, return_inverse=True)
        c1 = np.bincount(inv, weights=c[word, 1], minlength=len(keys)).astype(np.int64)
        c0 = np.bincount(inv, weights=c[word, 0], minlength=len(keys)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c1), pa.array(c0)], ["gram", "c1", "c0"])

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in _tokens(text):
                c = seen.get(w)
                if c is None:
                    c = seen[w] = [0, 0]
                c[toxic] += 1
            if len(seen) > 300_000:
                yield out()
                seen.clear()
    if seen and (last := out()) is not None:
        yield last


#: Labels (a long and a flag) that go to every task, so that no text is shuffled to meet them.
BROADCAST_LABELS = 4_000_000


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic`` of the documents with a usable label."""
    lab = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .where(F.col("toxic").isin(0, 1)).distinct())
    lab = staged(lab, "toxicity-labels")
    if lab.count() <= BROADCAST_LABELS:        # counted; beyond it the same join shuffles texts and labels
        lab = F.broadcast(lab)
    return texts(docs).join(lab, "doc_id")


def fit(rows: DataFrame) -> dict:
    """Model arrays from ``doc_id, text, toxic`` rows: counts over all of them but the calibration rows."""
    spark = rows.sparkSession
    ship_package(spark)
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(10)) == 0
    n_rows = rows.count()
    if n_rows > 10 * CALIBRATION_ROWS:         # of a tenth that is more, the rest goes to the counts
        held &= F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * 10 * CALIBRATION_ROWS / n_rows)
    counts = (rows.where(~held).select("text", "toxic").mapInArrow(_count_batches, _COUNT_SCHEMA)
              .groupBy("gram").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")))
    counts = staged(counts, "toxicity-counts")

    # types[n]: the class counts of order n; below the longest, the number of distinct left neighbours
    types = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        gram = F.col("gram").bitwiseAND(F.lit((1 << (8 * n)) - 1))
        t = (types[n + 1].groupBy(gram.alias("gram"))
             .agg(F.sum((F.col("c1") > 0).cast("bigint")).alias("c1"), F.sum((F.col("c0") > 0).cast("bigint")).alias("c0")))
        if n <= SHARED:
            t = t.select("gram", (F.col("c1") + F.col("c0")).alias("c1"), (F.col("c1") + F.col("c0")).alias("c0"))
        types[n] = t

    # probabilities from the shortest order up; a context's mass left over goes to the shorter one
    d = F.lit(DISCOUNT)
    total = types[1].agg(F.coalesce(F.sum("c1"), F.lit(0))).first()[0]      # one number
    prob = types[1].select("gram", ((F.col("c1") + 1.0) / (total + 256.0)).alias("p1"),
                           ((F.col("c0") + 1.0) / (total + 256.0)).alias("p0"))
    parts = []
    for n in range(2, ORDER + 1):
        ctx = F.shiftright("gram", 8)
        low = F.col("gram").bitwiseAND(F.lit((1 << (8 * (n - 1))) - 1))
        t = types[n].select("gram", "c1", "c0", ctx.alias("h"), low.alias("low"))
        h = t.groupBy("h").agg(*[f for c in ("1", "0") for f in (
            F.sum(f"c{c}").alias(f"a{c}"), F.sum((F.col(f"c{c}") > 0).cast("bigint")).alias(f"t{c}"))])
        back = {c: F.when(F.col(f"a{c}") > 0, d * F.col(f"t{c}") / F.col(f"a{c}")).otherwise(F.lit(1.0)) for c in "10"}
        own = {c: F.when(F.col(f"a{c}") > 0, F.greatest(F.col(f"c{c}") - d, F.lit(0.0)) / F.col(f"a{c}"))
               .otherwise(F.lit(0.0)) for c in "10"}
        p = (t.join(h, "h").join(prob.select(F.col("gram").alias("low"), F.col("p1").alias("q1"), F.col("p0").alias("q0")), "low")
             .select("gram",
                     (own["1"] + back["1"] * F.col("q1")).alias("p1"), (own["0"] + back["0"] * F.col("q0")).alias("p0")))
        p = staged(p, f"toxicity-order{n}")
        prob = p.select("gram", "p1", "p0")
        if n <= SHARED:
            continue
        parts.append(p.select(F.lit(0).alias("kind"), F.lit(n).alias("n"), F.col("gram").alias("key"),
                              F.log(F.col("p1") / F.col("p0")).alias("v")))
        parts.append(h.select(F.lit(1).alias("kind"), F.lit(n).alias("n"), F.col("h").alias("key"),
                              F.log(back["1"] / back["0"]).alias("v")))
        if n == ORDER:                     # plain likelihoods for the report: P of the longest order, ordinary class
            parts.append(p.select(F.lit(2).alias("kind"), F.lit(n).alias("n"), F.col("gram").alias("key"),
                                  F.log("p0").alias("v")))
    table = parts[0]
    for x in parts[1:]:
        table = table.unionByName(x)
    got = table.select("kind", (F.col("key") * 8 + F.col("n")).alias("tag"), F.col("v").cast("float").alias("v")).toArrow()
    model = {}
    kind = got.column("kind").to_numpy()
    tag, v = got.column("tag").to_numpy(), got.column("v").to_numpy()
    for k in range(3):
        m = kind == k
        order = np.argsort(tag[m])         # tags are exact n-grams: a look-up never takes a stranger's value
        model[f"tag{k}"], model[f"v{k}"] = tag[m][order], v[m][order]
    model["w"] = None
    model["w"] = _fit_logistic(rows.where(held), model)
    return model


def _find(tags: np.ndarray, values: np.ndarray, key: np.ndarray, n: int):
    want = key * 8 + n
    if not len(tags):
        return np.zeros(len(key), bool), np.zeros(len(key))
    at = np.minimum(np.searchsorted(tags, want), len(tags) - 1)
    hit = tags[at] == want
    return hit, np.where(hit, values[at], 0.0)


def word_scores(vocab: list[str], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word: log-likelihood ratio, ordinary log-likelihood (longest order), predicted bytes."""
    gram, word = _grams(vocab)
    llr = np.zeros(len(gram))
    base, seen = np.full(len(gram), np.log(1 / 256.0)), None
    open_ = np.ones(len(gram), bool)
    for n in range(ORDER, SHARED, -1):
        idx = np.flatnonzero(open_)
        key = gram[idx] & ((1 << (8 * n)) - 1)
        uniq, inv = np.unique(key, return_inverse=True)
        hit, v = _find(model["tag0"], model["v0"], uniq, n)
        bhit, bv = _find(model["tag1"], model["v1"], uniq >> 8, n)
        llr[idx] += np.where(hit, v, bv)[inv]
        if n == ORDER:
            phit, pv = _find(model["tag2"], model["v2"], uniq, n)
            base[idx] = np.where(phit, pv, np.log(1 / 256.0))[inv]
        open_[idx[hit[inv]]] = False
    k = len(vocab)
    return (np.bincount(word, weights=llr, minlength=k), np.bincount(word, weights=base, minlength=k),
            np.bincount(word, minlength=k))


def _features(batch: list[str | None], model: dict):
    ids: dict[str, int] = {}
    toks = [[ids.setdefault(w, len(ids)) for w in _tokens(t)] for t in batch]
    llr, base, size = word_scores(list(ids), model)
    x = np.zeros((len(batch), FEATURES))
    ll = np.zeros((len(batch), 2))
    for i, t in enumerate(toks):
        if not t:
            continue
        a = np.array(t)
        v, n = llr[a], size[a].sum()
        strong = np.sort(np.partition(v, -TOP)[-TOP:] if len(v) > TOP else v)[::-1]
        x[i] = v.sum() / n, strong[0] / 10, strong.sum() / (10 * TOP), np.maximum(v - 1.0, 0).sum() / n
        o = base[a].sum() / n
        ll[i] = o + v.sum() / n, o
    return x, ll


def _fit_logistic(rows: DataFrame, model: dict) -> list[float]:
    sample = rows.select("doc_id", "text", "toxic").orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), "doc_id")
    got = _feature_frame(sample, model).toArrow()
    y = got.column("toxic").to_numpy()
    if not len(y) or y.min() == y.max():
        return []
    x = np.stack([got.column(f"x{k}").to_numpy() for k in range(FEATURES)], axis=1)
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    w = np.zeros(z.shape[1])
    for _ in range(50):                    # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + 1e-2 * np.r_[0, w[1:]]
        hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-2 * np.eye(z.shape[1])
        step = np.linalg.solve(hess, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return [float(w[0] - (w[1:] * mean / sd).sum()), *(w[1:] / sd).tolist()]


def _feature_frame(sample: DataFrame, model: dict) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def one(b):
        x, _ = _features(b.column(1).to_pylist(), shared.value)
        return pa.RecordBatch.from_arrays([b.column(2), *[pa.array(x[:, k]) for k in range(FEATURES)]],
                                          ["toxic", *[f"x{k}" for k in range(FEATURES)]])

    return map_batches(sample, one, "toxic int, " + ", ".join(f"x{k} double" for k in range(FEATURES)))


def _probability(batch: list[str | None], model: dict) -> np.ndarray:
    """Score and the two log-likelihoods of every text."""
    x, ll = _features(batch, model)
    w = np.array(model["w"])
    p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))) if len(w) else np.zeros(len(x))
    return np.c_[p, ll]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score, ll_toxic, ll_ordinary`` of every row; log-likelihoods are per predicted byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(b):
        r = np.concatenate([_probability(s.column(1).to_pylist(), shared.value) for s in slices(b, "text", 4 << 20)])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(r[:, 0]), pa.array(r[:, 1]), pa.array(r[:, 2])],
                                          ["doc_id", "score", "ll_toxic", "ll_ordinary"])

    return map_batches(texts(docs), one, "doc_id bigint, score double, ll_toxic double, ll_ordinary double")


def flag(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` beside its own columns (which must not be named so)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(list(docs.schema.fields)).add("score", "double").add("predicted", "integer")
    at = docs.columns.index("text")

    def one(b):
        p = np.concatenate([_probability(s.column(at).to_pylist(), shared.value)[:, 0] for s in slices(b, "text", 4 << 20)])
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                          [*b.schema.names, "score", "predicted"])

    return map_batches(docs, one, schema)


def in_training_fold(doc_id):
    """Rows whose crc32 of the id's text is not divisible by 5 may be learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != 0


def train(docs: DataFrame, labels: DataFrame) -> dict:
    return fit(labelled(docs, labels).where(in_training_fold(F.col("doc_id"))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, ll_toxic, ll_ordinary``."""
    s = score(docs, train(docs, labels))
    return s.select("doc_id", F.coalesce(~in_training_fold(F.col("doc_id")), F.lit(False)).alias("held_out"),
                    "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "ll_toxic", "ll_ordinary")
