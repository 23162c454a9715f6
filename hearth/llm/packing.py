"""Best-two-fit packing of token sequences.

Tokenising is the only pass over the texts; from there on a piece is a short row.  What a bin can
hold depends on lengths alone, so the bins are planned on the histogram of piece lengths, which
has at most ``CAPACITY`` entries whatever the corpus: a bin is filled greedily (longest that fits
first), then its smallest document gives way to the two unpacked ones that fill the expanded gap
best, if they fill it more tightly.  A bin's pattern is repeated as often as the histogram allows.  Pieces of one
length are numbered in Spark (per length and salt, so a length that very many share is
split) and take their places by number.

Defined results: null text is empty (its one token is the end mark); rows with an equal ``doc_id``
are packed each on their own; extra columns are ignored; an empty table packs into nothing.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import map_batches, staged, texts
from .token_alignment import _OPEN, byte_level
from .wordwise import Memo, chain, give_back, numbered, pieces_of

CAPACITY = 2048
END = 0
SLICE = 1 << 20                                # bytes of text encoded at once


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts.

    A byte-level vocabulary never joins tokens over a single blank, so a text is cut there in Arrow and its words' ids
    are remembered (:mod:`.wordwise`); a text with other white space around blanks, or where a special token may stand,
    goes to the tokenizer whole.  Tests compare the ids with the tokenizer's."""

    def __init__(self, path: str):
        side = byte_level(path, special=True, remembered=120_000)
        self.tok, self.words = side.tokenizer, side.ids         # words: ids of a blank and the word
        self.first = Memo(lambda words: [np.array(e.ids, "<u4").tobytes()
                                         for e in self.tok.encode_batch_fast(words, add_special_tokens=False)], size=20_000)

    def forget(self) -> None:
        """Give the remembered words' memory back: a worker goes on to other stages with other models."""
        self.words.forget()
        self.first.forget()
        give_back()

    def encode(self, col: pa.Array) -> Iterator[bytes]:
        """Every text's ids as little-endian 32-bit words (null: none), in order."""
        col = pc.fill_null(pc.cast(col, pa.large_string()), "")
        whole = pc.or_(pc.match_substring_regex(col, _OPEN), pc.match_substring(col, "<|"))
        words = pc.split_pattern(col.filter(pc.invert(whole)), " ")
        offset = np.asarray(words.offsets)
        flat, offset = words.flatten(), offset - offset[0]
        begins = np.zeros(len(flat), bool)
        begins[offset[:-1]] = True                              # every text has a word, the empty one the empty word
        first, first_at = numbered(flat.filter(pa.array(begins)))
        rest, rest_at = numbered(flat.filter(pa.array(~begins)))
        index = np.empty(len(flat), np.int64)
        index[begins], index[~begins] = first_at, rest_at + len(first)
        ids, length = chain(self.first(first) + self.words(rest), index, "<u4")
        upto = np.concatenate([[0], np.cumsum(length)])[offset]
        data = ids.tobytes()
        cuts = iter(zip((4 * upto[:-1]).tolist(), (4 * upto[1:]).tolist(), strict=True))
        for k, w in enumerate(whole.to_pylist()):
            if w:
                yield np.array(self.tok.encode(col[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
            else:
                s, e = next(cuts)
                yield data[s:e]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: a document's ids and the end mark; a longer one in pieces, the first the shorter."""
    path = tokenizer or default_tokenizer()
    end, width = np.array([END], "<u4").tobytes(), 4 * CAPACITY

    def one(b):
        enc, rows, col = _encoder(path), [], b.column(1)
        for k, stop in pieces_of(col, SLICE):
            for i, ids in enumerate(enc.encode(col.slice(k, stop - k)), start=k):
                ids += end
                at, first = 0, len(ids) % width or width
                cuts = [0, *range(first, len(ids) + 1, width)]
                for p, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((i, p, s // 4, (e - s) // 4, zlib.crc32(ids[s:e])))
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(c[0])), pa.array(c[1], pa.int32()), *[pa.array(x, pa.int64()) for x in c[2:]]],
            ["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches):
        try:
            for b in batches:
                if b.num_rows:
                    yield one(b)
        finally:
            _encoder(path).forget()

    ship_package(docs.sparkSession)
    return texts(docs).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Bins for the histogram: per (length, first number) the places of the pieces numbered from there on."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    taken = np.zeros(capacity + 1, np.int64)          # numbers given out so far, by length
    out: dict[str, list[int]] = {k: [] for k in ("length", "number", "each", "bin", "offset")}
    bins = 0
    sizes = np.arange(capacity + 1)
    while left.any():
        have, room, used = left.copy(), capacity, {}

        def take(x, have=have, used=used):
            have[x] -= 1
            used[x] = used.get(x, 0) + 1

        fits = np.maximum.accumulate(np.where(have > 0, sizes, 0))      # the longest left of at most x
        x = int(fits[room])
        while x:
            n = min(int(have[x]), room // x)
            have[x] -= n
            used[x] = used.get(x, 0) + n
            room -= n * x
            if room == 0:
                break
            if have[x] == 0:
                fits = np.maximum.accumulate(np.where(have > 0, sizes, 0))
            x = int(fits[room])
        if room and used:
            s = min(used)                                               # its smallest document
            gap = room + s
            if have.any():
                fits = np.maximum.accumulate(np.where(have > 0, sizes, 0))
                a = sizes[1:gap][have[1:gap] > 0]
                b = fits[gap - a]
                twin = (b == a) & (have[a] < 2)
                b[twin] = fits[a[twin] - 1]
                total = np.where(b > 0, a + b, 0)
                if len(total) and total.max() > s:
                    k = int(total.argmax())
                    used[s] -= 1
                    have[s] += 1
                    if not used[s]:
                        del used[s]
                    take(int(a[k]))
                    take(int(b[k]))
        times = min(int(left[x]) // n for x, n in used.items())
        offset = 0
        for x in sorted(used, reverse=True):
            n = used[x]
            for key, v in zip(out, (x, int(taken[x]), n, bins, offset), strict=True):
                out[key].append(v)
            offset += n * x
            taken[x] += n * times
            left[x] -= n * times
        bins += times
    order = np.lexsort((out["number"], out["length"])) if out["length"] else np.zeros(0, np.int64)
    return {k: np.array(v, np.int64)[order] for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = staged(pieces(docs, tokenizer), "pieces").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    count = staged(rows.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-counts")   # at most CAPACITY x salts
    histogram = {r[0]: r[1] for r in count.groupBy("length").agg(F.sum("n")).collect()}           # at most CAPACITY
    shared = spark.sparkContext.broadcast(plan(histogram))
    before = (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before")
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = (rows.withColumn("k", number).join(count.select("length", "salt", before), ["length", "salt"])
                .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("k") - 1).alias("number")))

    def one(b):
        p = shared.value
        length, k = np.asarray(b.column("length")), np.asarray(b.column("number"))
        at = np.searchsorted((p["length"] << 48) | p["number"], (length << 48) | k, side="right") - 1
        k = k - p["number"][at]
        seq = p["bin"][at] + k // p["each"][at]
        off = p["offset"][at] + k % p["each"][at] * length
        return pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)],
                                          ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return map_batches(numbered, one, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
                       "sequence_id bigint, offset bigint")
