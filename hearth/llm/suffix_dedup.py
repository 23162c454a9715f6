"""Exact substring dedup by a blockwise suffix sort with a difference cover.

A byte goes when a ``LENGTH``-byte string that covers it also starts in a document with a smaller
``doc_id``.  Sorting every suffix of a corpus would move many times its bytes, so the construction is
blockwise and skips the blocks that cannot matter:

1. *Blocks.*  A suffix (its first ``LENGTH`` bytes) belongs to the block of the least-hashed
   ``ANCHOR``-byte string inside it.  Equal suffixes share their block and their place in it, so a
   block met in one document only holds no repeat and no suffix of it is cut.  A bit map of the other
   blocks goes to the tasks (four bits or more a block, ``FILTER_BITS`` at most); a wrong bit costs a row, never a
   result.  A suffix reaches ``REACH`` bytes or more beyond its block's string on one side, so an occurrence takes
   part only if the string with the ``REACH`` bytes before it, or with those behind it, is met in two documents as well.
2. *Contexts.*  What is left of a block is its occurrences' surroundings, from the first to the last
   suffix that it names (at most ``2 * LENGTH - ANCHOR`` bytes).  An occurrence in a later document than
   the first one with the same context lies inside a repeat as a whole.
3. *Suffix sort.*  Only first occurrences of contexts, in blocks with several different ones, are
   left.  Their suffixes are sorted one bucket (of whole blocks, of bounded size) at a time, by
   ``COVER_MOD`` leading and as many last bytes; ties between are resolved by ranks of the
   difference-cover sample, ranked beforehand by the ``LENGTH - COVER_MOD`` bytes that follow: any two
   positions have a common distance under ``COVER_MOD`` at which both are in the sample.  A block of
   more than ``BLOCK_ROWS`` contexts is not sorted in one task: its suffixes are dealt out by their own
   content instead, equal ones merged before the shuffle.

Every document's removed bytes are the union of the repeats found in 2 and 3.

Defined results: null text is empty; a text under ``LENGTH`` bytes loses nothing; rows with an equal
``doc_id`` are no smaller than each other, so neither removes from the other; a null ``doc_id`` counts
as the smallest; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import Stages, map_batches

LENGTH = 50                                  # bytes of a repeat
ANCHOR = 20                                  # bytes of the string that names a suffix's block
COVER_MOD = 16
FILTER_BITS = 1 << 29                        # of a bit map at most (64 MB)
REACH = (LENGTH - ANCHOR) // 2
BUCKET_ROWS = 20_000                         # contexts in a bucket, about
BLOCK_ROWS = 50_000                          # contexts of a block that is sorted in one task, at most

_PLACES = LENGTH - ANCHOR + 1                # anchors inside a suffix
_TABLE = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = 0x9E3779B97F4A7C15
_M = np.uint64(0xC2B2AE3D27D4EB4F)
_POWER = {n: np.uint64(pow(_A, n, 1 << 64)) for n in (1, 2, 4, 8, 16)}


def _difference_cover(v: int) -> list[int]:
    """A small set of residues whose differences are all residues modulo ``v``."""
    from itertools import combinations
    for size in range(1, v + 1):
        for c in combinations(range(1, v), size - 1):
            d = (0, *c)
            if len({(a - b) % v for a in d for b in d}) == v:
                return list(d)
    return list(range(v))


COVER = _difference_cover(COVER_MOD)
_IN_COVER = np.isin(np.arange(COVER_MOD), COVER)
#: Least common distance to the sample, by the two positions' residues.
_DISTANCE = np.array([[next(k for k in range(COVER_MOD) if _IN_COVER[(a + k) % COVER_MOD] and _IN_COVER[(b + k) % COVER_MOD])
                       for b in range(COVER_MOD)] for a in range(COVER_MOD)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M
    return x ^ (x >> np.uint64(32))


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``ANCHOR`` (16 + 4) bytes from every position on."""
    x = _TABLE[data]
    x = x[:-1] * _POWER[1] + x[1:]
    x = four = x[:-2] * _POWER[2] + x[2:]
    x = x[:-4] * _POWER[4] + x[4:]
    x = x[:-8] * _POWER[8] + x[8:]
    n = len(data) - ANCHOR + 1
    return _mix(x[:n] * _POWER[4] + four[16:16 + n])


def blocks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of the texts that ``bounds`` cuts ``data`` into, as (hashes of all anchors, text, block hash, first
    suffix in ``data``, number of suffixes)."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4)
    if len(data) < LENGTH:
        return none
    h = anchor_hashes(data)
    m = h
    for s in (1, 2, 4, 8, _PLACES - 16):     # least hash of _PLACES places, by doubling
        m = np.minimum(m[:len(m) - s], m[s:])
    turn = np.empty(len(m), bool)            # where a suffix has another anchor than the one before
    turn[0] = True
    turn[1:] = (m[1:] != m[:-1]) | (h[:len(m) - 1] == m[:-1])
    size = np.diff(bounds)
    turn[bounds[:-1][(size > 0) & (bounds[:-1] < len(m))]] = True
    last = np.repeat(bounds[1:] - LENGTH, size)[:len(m)]     # a text's last suffix
    inside = np.arange(len(m)) <= last
    turn[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(turn)
    count = np.diff(np.r_[first, len(m)])
    ok = inside[first]
    first, count = first[ok], count[ok]
    if not len(first):
        return none
    text = np.searchsorted(bounds, first, side="right") - 1
    return h, text, m[first].view(np.int64), first, count


def places(h: np.ndarray, block: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where in ``data`` each context's block string is: the leftmost place of the least hash."""
    p = np.empty(len(first), np.int64)
    least = block.view(np.uint64)
    for k in range(0, len(first), 1 << 14):
        f = first[k:k + (1 << 14)]
        p[k:k + (1 << 14)] = f + (h[f[:, None] + np.arange(_PLACES)] == least[k:k + (1 << 14)][:, None]).argmax(axis=1)
    return p


def sides(h: np.ndarray, p: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the block's string with the ``REACH`` bytes before it, and with those behind it; where no suffix reaches
    so far, the other one again."""
    before, behind = p - first >= REACH, p - first - count + 1 <= LENGTH - ANCHOR - REACH
    left = _mix(h[p] * _POWER[1] + h[np.where(before, p - REACH, p)])
    right = _mix(h[p] * _POWER[2] + h[np.where(behind, p + REACH, p)])
    left, right = np.where(before, left, right), np.where(behind, right, left)
    return left.view(np.int64), right.view(np.int64)


def context_hash(h: np.ndarray, p: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    end = first + count - 1 + LENGTH
    c = _mix(h[first] * _POWER[1] + h[first + ANCHOR])
    c = _mix(c * _POWER[2] + h[end - 2 * ANCHOR])
    c = _mix(c * _POWER[4] + h[end - ANCHOR])
    return _mix(c + ((p - first) * 64 + count).astype(np.uint64)).view(np.int64)


def _cut(b: pa.RecordBatch, column: str, most: int = 1 << 18):
    """Buffers of about ``most`` bytes, as (bytes, bounds of the pieces, row and offset of each).  A piece is a whole
    text, or of a longer one the next ``most`` suffixes with the bytes that the last of them needs."""
    part, rows, offs, size = [], [], [], 0

    def full():
        return np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]), np.array(rows), np.array(offs)

    for i, x in enumerate(b.column(column)):
        raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(raw) - LENGTH + 1), most):
            part.append(raw[at:at + most + LENGTH - 1])
            rows.append(i)
            offs.append(at)
            size += len(part[-1])
            if size >= most:
                yield full()
                part, rows, offs, size = [], [], [], 0
    if part:
        yield full()


_LEAST = -(1 << 63)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST)).alias("id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("rk", F.xxhash64("text"))


def _holds(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key & (len(bits) * 64 - 1)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _bit_map(keys: DataFrame) -> np.ndarray:
    """Bit map of the column ``h``, of a size that goes with the number of rows."""
    n = min(max(1 << 16, 1 << (4 * keys.count()).bit_length()), FILTER_BITS)
    at = F.pmod(F.col("h"), F.lit(n))
    got = (keys.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int")).alias("bit"))
           .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    bits = np.zeros(n // 64, np.int64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return bits.view(np.uint64)


def _met_twice(texts: DataFrame, keys, work: Stages, name: str) -> np.ndarray:
    """Bit map of the keys that two documents or more have; ``keys`` gives (piece, key) of a buffer."""
    def one(b):
        out = [np.zeros((2, 0), np.int64)]
        ids = np.asarray(b.column("id"))
        for data, bounds, rows, _ in _cut(b, "text"):
            t, h = keys(data, bounds)
            out.append(np.stack([h, ids[rows[t]]]))
        h, d = np.concatenate(out, axis=1)
        if not len(h):
            return None
        o = np.argsort(h)
        h, d = h[o], d[o]
        head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(h[head]), pa.array(np.minimum.reduceat(d, head)), pa.array(np.maximum.reduceat(d, head))],
                                          ["h", "lo", "hi"])

    seen = map_batches(texts, one, "h bigint, lo bigint, hi bigint").groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    bits = _bit_map(work.write(seen.where("lo < hi").select("h"), name))
    work.drop(name)
    return bits


def _contexts(texts: DataFrame, work: Stages) -> DataFrame:
    """``h, c, id, rk, first, count`` of every context in a block that two documents share, where one side of the
    block's string is shared as well."""
    def block(data, bounds):
        _, t, block, *_ = blocks(data, bounds)
        return t, block

    context = texts.sparkSession.sparkContext.broadcast
    shared = context(_met_twice(texts, block, work, "suffix-blocks"))

    def of_shared(data, bounds):
        """The contexts in shared blocks only, and where their blocks' strings are."""
        h, *rows = blocks(data, bounds)
        k = np.flatnonzero(_holds(shared.value, rows[1]))
        t, block, first, count = (x[k] for x in rows)
        return h, t, block, first, count, places(h, block, first)

    def beside_keys(data, bounds):
        h, t, _, first, count, p = of_shared(data, bounds)
        return np.r_[t, t], np.r_[sides(h, p, first, count)]

    beside = context(_met_twice(texts, beside_keys, work, "suffix-sides"))

    def one(b):
        out = []
        for data, bounds, rows, offs in _cut(b, "text"):
            h, *found = of_shared(data, bounds)
            left, right = sides(h, found[4], found[2], found[3])
            k = np.flatnonzero(_holds(beside.value, left) | _holds(beside.value, right))
            t, block, first, count, p = (x[k] for x in found)
            out.append(np.stack([block, context_hash(h, p, first, count), rows[t], first - bounds[t] + offs[t], count]))
        h, c, t, first, count = np.concatenate(out, axis=1)
        rows = pa.array(t)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), b.column("id").take(rows), b.column("rk").take(rows),
                                           pa.array(first, pa.int64()), pa.array(count, pa.int64())],
                                          ["h", "c", "id", "rk", "first", "count"])

    return map_batches(texts, one, "h bigint, c bigint, id bigint, rk bigint, first bigint, count bigint")


def _word(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from ``at`` on as one number."""
    x = np.zeros(len(at), np.uint64)
    for k in range(8):
        x = (x << np.uint64(8)) | buf[at + k]
    return x


def sort_suffixes(buf: np.ndarray, start: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Class of each suffix: equal numbers where the first ``length`` bytes from ``start`` on are equal.

    Sorted by leading and last ``COVER_MOD`` bytes; longer ties by ranks of the cover sample."""
    v, deep = COVER_MOD, length - COVER_MOD
    keys = [_word(buf, start + k) for k in (0, 8, deep, deep + 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        x = k[order]
        new[1:] |= x[1:] != x[:-1]
    tie = np.empty(len(order), np.int64)
    tie[order] = np.cumsum(new) - 1
    alone = np.bincount(tie) == 1
    open_ = np.flatnonzero(~alone[tie])
    if not len(open_):
        return tie
    # ranks of the sample positions that ties can reach, by the bytes between
    reached = np.zeros(len(buf) + v, bool)
    for k in range(v):
        reached[start[open_] + k] = True
    near = np.flatnonzero(reached)
    sample = near[_IN_COVER[near % v]]
    cols = [_word(buf, sample + k) for k in range(0, deep - 7, 8)]
    if deep % 8:
        cols.append(_word(buf, sample + deep - 8))
    o = np.lexsort(cols[::-1])
    step = np.zeros(len(o), bool)
    for k in cols:
        x = k[o]
        step[1:] |= x[1:] != x[:-1]
    rank = np.full(len(buf), -1, np.int64)
    rank[sample[o]] = np.cumsum(step)
    out, fresh = tie.copy(), int(tie.max()) + 1
    while len(open_):                        # each round settles the suffixes that equal their tie's first
        t = tie[open_]
        o = np.argsort(t, kind="stable")
        open_, t = open_[o], t[o]
        head = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        ref = np.repeat(start[open_[head]], np.diff(np.r_[head, len(t)]))
        own = start[open_]
        d = _DISTANCE[own % v, ref % v]
        same = rank[own + d] == rank[ref + d]
        number = np.cumsum(np.isin(np.arange(len(t)), head)) - 1 + fresh
        out[open_[same]] = number[same]
        fresh += len(head)
        open_ = open_[~same]
    return out


_SPANS = "id bigint, rk bigint, s bigint, e bigint"


def _sort_bucket(table: pa.Table) -> pa.Table:
    """Spans of a bucket's suffixes that also start in a smaller document."""
    ctx, count = table.column("ctx").to_pylist(), np.asarray(table.column("count"))
    ids, first = np.asarray(table.column("id")), np.asarray(table.column("first"))
    size = np.fromiter(map(len, ctx), np.int64, len(ctx))
    buf = np.frombuffer(b"".join(ctx) + bytes(COVER_MOD), np.uint8)
    row = np.repeat(np.arange(len(ctx)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    cls = sort_suffixes(buf, (np.cumsum(size) - size)[row] + k)
    least = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, cls, ids[row])
    hit = ids[row] > least[cls]
    return _runs(table, row[hit], k[hit], first)


def _runs(table, row, k, first):
    """Neighbouring suffixes of a row as one span."""
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (k[1:] != k[:-1] + 1)]) if len(row) else np.zeros(0, np.int64)
    tail = np.r_[head[1:], len(row)] - 1 if len(head) else head
    s = first[row[head]] + k[head]
    e = first[row[tail]] + k[tail] + LENGTH
    rows = pa.array(row[head])
    return pa.table([table.column("id").take(rows), table.column("rk").take(rows), pa.array(s, pa.int64()), pa.array(e, pa.int64())],
                    names=["id", "rk", "s", "e"])


def _large(ctx: DataFrame, work: Stages) -> DataFrame:
    """The same for blocks too large for a task: every suffix dealt out by a 128-bit hash of its content."""
    from hashlib import blake2b

    def one(b):
        rows, names, places = [], [], []
        for i, (c, n) in enumerate(zip(b.column("ctx").to_pylist(), b.column("count").to_pylist(), strict=True)):
            for k in range(n):
                names.append(blake2b(c[k:k + LENGTH], digest_size=16).digest())
                rows.append(i)
                places.append(k)
        at = pa.array(rows, pa.int64())
        s = np.asarray(b.column("first"))[rows] + np.array(places, np.int64)
        return pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("rk").take(at), pa.array(s, pa.int64()),
                                           pa.array(names, pa.binary())], ["id", "rk", "s", "name"])

    w = work.write(map_batches(ctx, one, "id bigint, rk bigint, s bigint, name binary"), "suffix-large")
    least = w.groupBy("name").agg(F.min("id").alias("least"))
    return w.join(least, "name").where("id > least").select("id", "rk", "s", (F.col("s") + LENGTH).alias("e"))


def removed_spans(docs: DataFrame) -> DataFrame:
    """``id, rk, s, e``: byte spans inside repeats, per text (``rk`` is its hash); they may overlap."""
    spark, texts = docs.sparkSession, _texts(docs)
    ship_package(spark)
    work = Stages(spark)
    rows = work.write(_contexts(texts, work), "suffix-contexts")
    # written first: a join whose side is still being aggregated in the same stage cannot be split where a key is hot
    least = work.write(rows.groupBy("h", "c").agg(F.min("id").alias("least")), "suffix-least")
    found = work.write(rows.join(least, ["h", "c"]).withColumn("later", F.col("id") > F.col("least")).drop("least"), "suffix-judged")
    work.drop("suffix-contexts")
    end = F.col("first") + F.col("count") - 1 + LENGTH
    spans = found.where("later").select("id", "rk", F.col("first").alias("s"), end.alias("e"))
    own = found.where("not later")
    several = work.write(least.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "suffix-several")
    work.drop("suffix-least")
    left = own.join(several, "h")
    need = left.groupBy("id", "rk").agg(F.collect_set(F.struct("h", "first", "count", "n")).alias("need"))

    def cut(b):
        rows_, ctx = [], []
        for i, (text, need_) in enumerate(zip(b.column("text").to_pylist(), b.column("need").to_pylist(), strict=True)):
            raw = text.encode("utf-8", "surrogatepass")
            for x in need_:
                ctx.append((i, x["h"], raw[x["first"]:x["first"] + x["count"] - 1 + LENGTH], x["first"], x["count"], x["n"]))
        i, h, c, first, count, n = zip(*ctx, strict=True)
        at = pa.array(i, pa.int64())
        return pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("rk").take(at), pa.array(h, pa.int64()), pa.array(c, pa.binary()),
                                           pa.array(first, pa.int64()), pa.array(count, pa.int64()), pa.array(n, pa.int64())],
                                          ["id", "rk", "h", "ctx", "first", "count", "n"])

    ctx = work.write(map_batches(texts.join(need, ["id", "rk"]).select("id", "rk", "text", "need"), cut,
                             "id bigint, rk bigint, h bigint, ctx binary, first bigint, count bigint, n bigint"), "suffix-left")
    work.drop("suffix-several")
    small = ctx.where(F.col("n") <= BLOCK_ROWS)
    buckets = int(small.count() // BUCKET_ROWS) + 1
    sorted_ = (small.select(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket"), "id", "rk", "ctx", "first", "count")
               .groupBy("bucket").applyInArrow(_sort_bucket, _SPANS))
    out = work.write(spans.unionByName(sorted_).unionByName(_large(ctx.where(F.col("n") > BLOCK_ROWS), work)), "suffix-spans")
    work.drop("suffix-judged", "suffix-left", "suffix-large")
    return out


def _keep(text: str, spans) -> tuple[int, int, int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    kept, at, removed, runs = [], 0, 0, 0
    for s, e in sorted(spans or ()):
        if s > at or not runs:
            runs += 1
            kept.append(raw[at:s])
            removed += e - s
            at = e
        elif e > at:
            removed += e - at
            at = e
    kept.append(raw[at:])
    return len(raw), removed, runs, b"".join(kept)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that are left)."""
    spans = removed_spans(docs)
    per = spans.groupBy("id", "rk").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    rows = _texts(docs).join(per, ["id", "rk"], "left")
    rows = rows.select(F.nullif("id", F.lit(_LEAST)).alias("doc_id"), "text", "spans")

    def one(b):
        rows = [_keep(t, [(x["s"], x["e"]) for x in s or ()]) for t, s in
                zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in c[:3]], pa.array(c[3], pa.binary())],
                                          ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_batches(rows, one, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
