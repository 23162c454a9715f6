"""SimHash near-duplicates found with a table of distances to reference fingerprints (pivots).

The table holds every distinct fingerprint's Hamming distance to ``len(PIVOTS)`` references.  By the triangle
inequality two fingerprints within ``MAX_BITS`` differ by at most ``MAX_BITS`` in every coordinate, so a
pair with a larger coordinate difference is discarded unseen; survivors are verified by their
own distance.  Pairs are met through coordinates too: references that lie inside one 16-bit block
give, relative to the reference zero, coordinates that depend on that block alone.  Two
fingerprints within 2 bits agree on two of the four blocks at least, hence on all coordinates of
these two, and meet in a cell of such a pair of blocks.

A cell of over ``CELL`` fingerprints (a large family of near copies) is not paired: its members meet at
their one-bit neighbours instead (65 rows each; two fingerprints are within 2 bits exactly when
they share a neighbour within 1), which joins the same components without any pair.

Defined results: null or empty texts have fingerprint zero and are linked like any other; rows with
an equal ``doc_id`` each get a row, and a component's id is the smallest ``doc_id`` among its rows that
is not null; extra columns are ignored.
"""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged, text_hash, texts
from .components import components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BLOCKS = 4
CELL = 256


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pivots() -> tuple[list[int], list[list[int]]]:
    """References inside each block (two dozen random masks each), then some over the whole word."""
    rng, inside, width = random.Random(64), [], 64 // BLOCKS
    for k in range(BLOCKS):
        inside.append([rng.getrandbits(width) << (k * width) for _ in range(24)])
    return [rng.getrandbits(64) for _ in range(16)], inside


WHOLE, INSIDE = _pivots()
PIVOTS = [0, *WHOLE, *(p for b in INSIDE for p in b)]


def fingerprint(text: str | None) -> int:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()       # bytes: A-Z, and six white spaces
    if not w:
        return 0
    h64, join = xxhash.xxh64_intdigest, b" ".join
    hashes = [h64(join(w[i:i + SHINGLE]), SEED) for i in range(max(1, len(w) - SHINGLE + 1))]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp`` (signed 64 bits) of every row."""
    def one(b):
        fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    return map_batches(texts(docs).withColumn("text_hash", text_hash()), one, "doc_id bigint, text_hash bigint, fp bigint")


def _distance(p: int):
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("tinyint")


def distance_table(fps: DataFrame) -> DataFrame:
    """``fp``, the coordinates of the wide references, and one cell key per pair of blocks."""
    zero = F.bit_count("fp")
    block = [F.xxhash64(*[(_distance(p) - zero).cast("int") for p in b]) for b in INSIDE]
    t = fps.select("fp", F.array(*[_distance(p) for p in (0, *WHOLE)]).alias("coord"),
                   *[b.alias(f"b{k}") for k, b in enumerate(block)])
    cells = [F.xxhash64(F.lit(k), f"b{i}", f"b{j}") for k, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - MAX_BITS))]
    return t.select("fp", "coord", F.explode(F.array(*cells)).alias("cell"))


def links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints: verified pairs, and star links of large cells."""
    table = distance_table(fps)
    size = staged(table.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    met = staged(table.join(size, "cell"), "simhash-cells")
    small = met.where(F.col("n") <= CELL)
    left = small.select("cell", F.col("fp").alias("a"), F.col("coord").alias("ca"))
    right = small.select("cell", F.col("fp").alias("b"), F.col("coord").alias("cb"))
    apart = F.greatest(*[F.abs(F.col("ca")[k] - F.col("cb")[k]) for k in range(len(WHOLE) + 1)])
    pairs = (left.join(right, "cell").where(F.col("a") < F.col("b")).where(apart <= MAX_BITS)
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b"))
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << k)) for k in range(64)])
    near = (met.where(F.col("n") > CELL).select("fp").distinct()
            .select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("z")))
    low = near.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = near.join(low, "z").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, fp, component_id`` of every row, and ``root``, a fingerprint that names its component (two components
    may have one ``component_id`` where rows of an equal ``doc_id`` differ, or where all ids are null)."""
    f = staged(fingerprints(docs), "simhash")
    first = staged(f.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    comp = components(links(first))
    root = first.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc_id")
    least = root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = staged(root.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "simhash-components")
    return f.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def representatives(found: DataFrame) -> DataFrame:
    """``doc_id, text_hash`` of one row of each component of :func:`near_duplicates`: the smallest ``doc_id`` that is not
    null, then the smallest hash."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("r")
    return found.groupBy("root").agg(least).select("r.doc_id", "r.text_hash")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
