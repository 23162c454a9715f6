"""Secret scan: fixed patterns, and character Markov models for strings that no pattern names.

Two Markov models of characters (each given the two before it) are trained on labelled samples: the
values that the fixed patterns find anywhere in the corpus, and ``DRAWN`` strings drawn from the usual
alphabets of keys, are random strings; all other long identifier-like runs of the corpus are ordinary
ones.  A run that meets no fixed match is a secret of kind
``random`` when its log-likelihood ratio is at least ``PER_CHAR`` a character and ``TOTAL`` in all.

Kinds and spans (code points, end exclusive; the whole match): ``assign`` (key word, separator,
value of 12+ characters), ``access`` (18+ characters), ``hex`` (16+ characters), ``random``.

Defined results: null text is empty and has no span; rows with an equal ``doc_id`` are scanned each
on their own; with no ordinary run in the corpus no ``random`` span is added; extra columns are
ignored.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import map_batches, sha256_hex, texts

DRAWN = 20_000                               # strings of 16 to 48 characters from the usual alphabets
RARE = 5                                     # taken off each count: an unlisted secret among the ordinary runs must not vouch for itself
PER_CHAR = 0.1
TOTAL = 4.0
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_N = len(ALPHABET) + 1                       # and the edge of a run
_CODE = np.full(256, _N - 1, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(_N - 1)

_ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_KEYWORD = re.compile(r"(?i:password|passwd|secret|token|api_?key)", re.ASCII)
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")          # runs are maximal, so shorter ones need no visit
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]], list[str]]:
    """Fixed matches as (start, kind, end), long runs as (start, end), and the matched values."""
    runs = [m.span() for m in _RUN.finditer(text)]
    spans, values = [], []
    for s, e in runs:                        # an access id or hex run of its length lies inside a long run
        for m in _ACCESS.finditer(text, s, e):
            if m.end() - m.start() >= 18:
                spans.append((m.start(), 1, m.end()))
                values.append(m.group())
        for m in _HEX.finditer(text, s, e):
            spans.append((m.start(), 2, m.end()))
            values.append(m.group())
    if runs:
        low = text.lower()
        if any(k in low for k in _KEYS):
            for m in _ASSIGN.finditer(text):
                if m.end(2) - m.start(2) >= 12:
                    spans.append((m.start(), 0, m.end()))
                    values.append(m.group(2))
    spans.sort()
    return spans, runs, values


def _free(runs, spans):
    """Runs that touch no fixed span (both sorted; fixed spans may overlap each other)."""
    out, k, reach = [], 0, -1
    for s, e in runs:
        while k < len(spans) and spans[k][0] < e:
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= s:
            out.append((s, e))
    return out


def _grams(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [b"\0\0" + s.encode() + b"\0" for s in strings]
    buf = _CODE[np.frombuffer(b"".join(raw), np.uint8)]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    n = size - 2
    owner = np.repeat(np.arange(len(raw)), n)
    at = np.repeat(np.cumsum(size) - size, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return (buf[at] * _N + buf[at + 1]) * _N + buf[at + 2], owner


def _sample_batches(batches):
    """Trigram counts of both samples, one partial table per task (at most 69^3 rows)."""
    total = np.zeros((2, _N ** 3), np.int64)
    for b in batches:
        pos, neg = [], []
        for text in b.column(0).to_pylist():
            if not text:
                continue
            spans, runs, values = base_spans(text)
            pos += values
            neg += [text[s:e] for s, e in _free(runs, spans)]
        for k, strings in ((1, pos), (0, neg)):
            if strings:
                total[k] += np.bincount(_grams(strings)[0], minlength=_N ** 3)
    g = np.flatnonzero(total.any(axis=0))
    if len(g):
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(total[1][g]), pa.array(total[0][g])], ["gram", "c1", "c0"])


def drawn() -> list[str]:
    """Random strings as keys are written: base 64 and 62, upper-case base 32 and 36, hexadecimal."""
    low, up, num = ALPHABET[26:52], ALPHABET[:26], ALPHABET[52:62]
    kinds = (up + low + num + "+/", up + low + num, up + "234567", up + num, low + num, num + "abcdef")
    rng = random.Random(62)
    return ["".join(rng.choices(kinds[k % len(kinds)], k=rng.randint(16, 48))) for k in range(DRAWN)]


def train(docs: DataFrame) -> np.ndarray | None:
    """Log-likelihood ratio of every trigram; ``None`` if a sample is empty.  At most 69^3 counts are gathered."""
    ship_package(docs.sparkSession)
    got = (texts(docs).select("text").mapInArrow(_sample_batches, "gram bigint, c1 bigint, c0 bigint")
           .groupBy("gram").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")).toArrow())
    c = np.zeros((2, _N ** 3))
    g = got.column("gram").to_numpy()
    c[1, g], c[0, g] = got.column("c1").to_numpy(), got.column("c0").to_numpy()
    if not c[0].sum():
        return None
    c[1] += np.bincount(_grams(drawn())[0], minlength=_N ** 3)
    logp = []
    for k in (0, 1):                         # trigram smoothed by bigram, bigram by unigram (absolute weights)
        t = c[k].reshape(_N, _N, _N)
        uni = (t.sum((0, 1)) + 0.5) / (t.sum() + 0.5 * _N)
        t = np.maximum(t - RARE, 0)
        two = t.sum(0)
        bi = (two + 5 * uni) / (two.sum(1, keepdims=True) + 5)
        tri = (t + 5 * bi[None]) / (t.sum(2, keepdims=True) + 5)
        logp.append(np.log(tri).ravel())
    return logp[1] - logp[0]


def _verdicts(strings: list[str], ratio: np.ndarray, cache: dict[str, bool]) -> None:
    new = [s for s in dict.fromkeys(strings) if s not in cache]
    if not new:
        return
    if len(cache) > 200_000:
        cache.clear()
    g, owner = _grams(new)
    llr = np.bincount(owner, weights=ratio[g], minlength=len(new))
    for s, v in zip(new, llr.tolist(), strict=True):
        cache[s] = v >= TOTAL and v >= PER_CHAR * (len(s) + 1)


def secret_spans(docs: DataFrame, ratio: np.ndarray | None) -> DataFrame:
    """``doc_id, spans`` with every span as (kind, start, end), in order of start, then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def one(b):
        table, cache, rows = shared.value, {}, []
        for text in b.column(1).to_pylist():
            spans, runs, _ = base_spans(text) if text else ([], [], [])
            free = _free(runs, spans) if table is not None else []
            if free:
                strings = [text[s:e] for s, e in free]
                _verdicts(strings, table, cache)
                spans = sorted(spans + [(s, 3, e) for (s, e), x in zip(free, strings, strict=True) if cache.get(x, False)])
            rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return map_batches(texts(docs), one, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def secret_scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every document, the models trained on all of them."""
    return secret_spans(docs, train(docs))


def digest(spans: DataFrame) -> DataFrame:
    """Counts and digests of the spans, per document."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        count("random"))
