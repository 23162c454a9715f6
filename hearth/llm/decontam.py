"""Benchmark decontamination with a stored positional inverted index, distributed by document.

:func:`build_index` writes the corpus' postings once: a row is a shard, a block of whole documents with the
terms it holds and every term's sorted positions, with gaps between documents so that no match crosses one.
:func:`matches` asks the stored index for the windows of a benchmark (13 consecutive words; a shorter item is
one window).  The terms are ranked by their counts over the whole corpus, read from the index; a window starts from
its rarest term, and the offset-adjusted list is intersected with the other terms' lists, rarest first, until only
exact phrases are left.

A proximity match is a stretch of ``NEAR_SPAN`` consecutive document words that holds at least four fifths of a
window's different terms (11 of 13), in any order.  Such a stretch holds one of the window's ``missing + 1`` rarest terms,
so only these lists are walked; a place is given up as soon as too many terms are not near it, and the
stretches around what is left are counted one by one.  Nothing in either match depends on how documents are dealt out to
shards, on their order or on the layout of files.

The benchmark, the stated query set, is taken in blocks of at most ``BLOCK_BYTES`` of text (a longer item is a block of its
own size); every block reads the index once.

Defined results: null or empty texts have no words; a null ``item_id``'s windows hit words but are
not listed; items with an equal id count once; rows with an equal ``doc_id`` are judged each on
their own; null ids stay null; extra columns are ignored; very long texts are cut into words piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import WORD_TABLE, map_batches, slices, staged, text_hash
from .wordwise import give_back

WINDOW = 13
NEAR_SPAN = 16
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20
SHARDS_A_FILE = 32                           # of about SHARD_BYTES each: bounds what a reader holds at once
PIECE_BYTES = 4 << 20
CANDIDATES = 1 << 20                         # places looked at together
_GAP = 2 * (WINDOW + NEAR_SPAN)

INDEX = ("shard bigint, doc_id array<bigint>, text_hash array<bigint>, n_words array<int>, terms array<string>, "
         "starts binary, positions binary")
MATCHES = ("shard bigint, place int, doc_id bigint, text_hash bigint, n_words bigint, runs array<struct<b:int,e:int>>, "
           "items array<string>, near array<struct<item_id:string,word:int>>")


def _pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a list for every ``PIECE_BYTES``."""
    data = text.encode("utf-8", "surrogatepass").translate(WORD_TABLE) if text else b""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _word_ids(text: str | None, vocab: dict[bytes, int]) -> np.ndarray:
    """The numbers of a text's words; new words are added to ``vocab``."""
    put = vocab.setdefault
    parts = [np.array([put(w, len(vocab)) for w in p], np.int32) for p in _pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _each(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn(batch) -> batches``, one a shard: no task holds the results of several; memory that the
    worker does not need any more is given back after each batch."""
    ship_package(df.sparkSession)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)
                give_back()

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- the stored index

def _shard_row(s: pa.RecordBatch) -> pa.RecordBatch:
    vocab: dict[bytes, int] = {}
    ids = [_word_ids(t, vocab) for t in s.column("text").to_pylist()]
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    term = np.concatenate(ids)
    pos = np.arange(len(term)) + _GAP * (1 + np.repeat(np.arange(len(ids)), sizes))
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(len(vocab) + 1))
    row = {"shard": s.column("row")[0].as_py(), "doc_id": s.column("doc_id").to_pylist(),
           "text_hash": s.column("text_hash").to_pylist(), "n_words": sizes.tolist(),
           "terms": [w.decode("utf-8", "surrogatepass") for w in vocab],
           "starts": starts.astype("<i4").tobytes(), "positions": pos[order].astype("<i4").tobytes()}
    types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))


def build_index(docs: DataFrame) -> DataFrame:
    """The positional inverted index of ``docs``: one row a shard.  ``terms[i]`` stands at the little-endian 32-bit
    ``positions[starts[i]:starts[i + 1]]``; document ``d`` of the shard begins ``_GAP`` behind the end of the one before."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       text_hash().alias("text_hash"), F.monotonically_increasing_id().alias("row"))

    return _each(rows, lambda b: map(_shard_row, slices(b, "text", SHARD_BYTES)), INDEX)


def stored_index(docs: DataFrame) -> DataFrame:
    """:func:`build_index`, written once."""
    return staged(build_index(docs), "decontam-index", {"maxRecordsPerFile": SHARDS_A_FILE})


# ---------------------------------------------------------------- the query set

class Queries:
    """A block of benchmark items as different windows of numbered terms."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        vocab: dict[bytes, int] = {}
        numbers: dict[str, int] = {}
        wins, owners = [], []
        for item, text in items:
            ids = _word_ids(text, vocab)
            if len(ids) == 0:
                continue
            own = -1 if item is None else numbers.setdefault(item, len(numbers))
            w = np.full((max(1, len(ids) - WINDOW + 1), WINDOW), -1, np.int32)
            if len(ids) < WINDOW:
                w[0, :len(ids)] = ids
            else:
                w[:] = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
            wins.append(w)
            owners.append(np.full(len(w), own, np.int32))
        self.items = list(numbers)
        self.vocab = pa.array([w.decode("utf-8", "surrogatepass") for w in vocab], pa.string())
        every = np.concatenate(wins) if wins else np.zeros((0, WINDOW), np.int32)
        self.windows, which = np.unique(every, axis=0, return_inverse=True)
        held = np.unique(np.stack([which.reshape(-1), np.concatenate(owners) if owners else which.reshape(-1)], 1), axis=0)
        held = held[held[:, 1] >= 0]
        self.owner_start = np.searchsorted(held[:, 0], np.arange(len(self.windows) + 1))
        self.owner = held[:, 1]
        self.size = (self.windows >= 0).sum(1)

    def rank(self, counts: np.ndarray) -> None:
        """Orders every window's offsets by their terms' corpus-wide counts; places of padding come last."""
        w = self.windows
        often = np.where(w >= 0, counts[w] if len(counts) else 0, np.iinfo(np.int64).max)
        self.by_rarity = np.argsort(often, axis=1, kind="stable").astype(np.int8)
        again = np.zeros(w.shape, bool)
        for j in range(1, WINDOW):
            again[:, j] = (w[:, :j] == w[:, j:j + 1]).any(1)
        often[again] = np.iinfo(np.int64).max
        self.different = np.argsort(often, axis=1, kind="stable").astype(np.int8)     # first offsets of different terms
        self.n_different = ((w >= 0) & ~again).sum(1)
        self.need = (4 * self.n_different + 4) // 5

    def owned(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a list of windows: the place in the list and the number of every item that holds the window."""
        at, rows = _ranges(self.owner_start[window], self.owner_start[window + 1])
        return rows, self.owner[at]


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range each is of."""
    n = high - low
    rows = np.repeat(np.arange(len(low)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[rows], rows


# ---------------------------------------------------------------- search in one shard

class Shard:
    """One row of the stored index."""

    def __init__(self, terms: pa.Array, starts: bytes, positions: bytes, n_words: np.ndarray):
        self.terms = terms
        self.start = np.frombuffer(starts, "<i4").astype(np.int64)
        self.pos = np.frombuffer(positions, "<i4").astype(np.int64)
        self.term = np.repeat(np.arange(len(terms)), np.diff(self.start))
        self.postings = (self.term << 32) | self.pos
        self.first = np.cumsum(n_words + _GAP) - n_words                  # position of each document's word 0

    def holds(self, term: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Is ``pos`` on the term's list?"""
        key = (term << 32) | pos
        at = np.minimum(np.searchsorted(self.postings, key), len(self.postings) - 1)
        return self.postings[at] == key

    def within(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.postings, (term << 32) | low)
        return self.postings[np.minimum(at, len(self.postings) - 1)] <= ((term << 32) | high)

    def document(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, pos, side="right") - 1

    def _places(self, rows: np.ndarray, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and the positions of their leading terms, about ``CANDIDATES`` at a time."""
        n = np.cumsum(self.start[term + 1] - self.start[term])
        cuts = np.flatnonzero(np.diff(n // CANDIDATES)) + 1
        for own, lead in zip(np.split(rows, cuts), np.split(term, cuts), strict=True):
            at, which = _ranges(self.start[lead], self.start[lead + 1])
            yield own[which], self.pos[at]

    def exact(self, q: Queries, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the positions at which they begin."""
        found = []
        own = np.flatnonzero(((terms >= 0) | (q.windows < 0)).all(1))
        for row, pos in self._places(own, terms[own, q.by_rarity[own, 0]]):
            begin = pos - q.by_rarity[row, 0]
            for j in range(1, WINDOW):
                off = q.by_rarity[row, j]
                ok = (q.size[row] <= j) | self.holds(terms[row, off], begin + off)
                row, begin = row[ok], begin[ok]
            found.append((row, begin))
        return _joined(found)

    def near(self, q: Queries, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows and the first words of the stretches that hold enough of their terms (a stretch begins with one of them)."""
        found = []
        listed = np.diff(q.owner_start) > 0
        for lead in range(WINDOW - (4 * WINDOW + 4) // 5 + 1):
            own = np.flatnonzero(listed & (lead <= q.n_different - q.need))
            term = terms[own, q.different[own, lead]]
            for row, pos in self._places(own[term >= 0], term[term >= 0]):
                missing = np.zeros(len(row), np.int64)
                for j in range(WINDOW):
                    t = terms[row, q.different[row, j]]
                    there = (t >= 0) & self.within(np.maximum(t, 0), pos - NEAR_SPAN + 1, pos + NEAR_SPAN - 1)
                    missing += (j < q.n_different[row]) & ~there
                    ok = missing <= q.n_different[row] - q.need[row]
                    row, pos, missing = row[ok], pos[ok], missing[ok]
                found += [self._stretches(q, terms, row[k:k + 8192], pos[k:k + 8192]) for k in range(0, len(row), 8192)]
        return _joined(found)

    def _stretches(self, q: Queries, terms: np.ndarray, row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "words"):
            self.words = np.full(int(self.pos.max()) + 2 * NEAR_SPAN, -2, np.int32)
            self.words[self.pos] = self.term
        place = pos[:, None] + np.arange(1 - NEAR_SPAN, NEAR_SPAN)
        word = self.words[place]                                          # documents are further apart than a stretch is long
        first = np.take_along_axis(terms[row], q.different[row].astype(np.int64), 1)
        first[np.arange(WINDOW) >= q.n_different[row][:, None]] = -1
        is_term = word[:, None, :] == first[:, :, None]
        seen = np.concatenate([np.zeros((*is_term.shape[:2], 1), np.int8), np.cumsum(is_term, 2, dtype=np.int8)], 2)
        held = (seen[:, :, NEAR_SPAN:] > seen[:, :, :-NEAR_SPAN]).sum(1)   # different terms by the stretch's first word
        ok = (held >= q.need[row][:, None]) & is_term.any(1)[:, :NEAR_SPAN]
        hit = np.flatnonzero(ok.any(1))
        return row[hit], place[hit, ok[hit].argmax(1)]


def _joined(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[x for x, _ in found]]), np.concatenate([none, *[y for _, y in found]])


def _covered(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal stretches that some ranges cover together."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(begin[1:] > end[:-1])
    return begin[np.r_[0, cut + 1]], end[np.r_[cut, len(end) - 1]]


def _search(row: dict, terms: pa.Array, q: Queries) -> pa.RecordBatch:
    """The matches of one shard, a row for each of its documents."""
    n_docs = len(row["doc_id"])
    n_words = np.array(row["n_words"], np.int64)
    runs: list[list] = [[] for _ in range(n_docs)]
    items: list[list] = [[] for _ in range(n_docs)]
    near: list[list] = [[] for _ in range(n_docs)]
    if len(terms) and len(q.windows):
        shard = Shard(terms, row["starts"], row["positions"], n_words)
        number = pc.fill_null(pc.index_in(q.vocab, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.where(q.windows >= 0, number[q.windows], -1)
        window, begin = shard.exact(q, own)
        low, high = _covered(begin, begin + q.size[window])
        doc = shard.document(low)
        for d, b, e in zip(doc.tolist(), (low - shard.first[doc]).tolist(), (high - shard.first[doc]).tolist(), strict=True):
            runs[d].append({"b": b, "e": e})
        at, item = q.owned(window)
        for d, i in np.unique(np.stack([shard.document(begin[at]), item], 1), axis=0).tolist():
            items[d].append(q.items[i])
        window, word = shard.near(q, own)
        at, item = q.owned(window)
        doc = shard.document(word[at])
        order = np.lexsort((word[at], item, doc))
        doc, item, word = doc[order], item[order], word[at][order]
        for k in np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0)]).tolist() if len(doc) else ():
            near[doc[k]].append({"item_id": q.items[item[k]], "word": int(word[k] - shard.first[doc[k]])})
    run, hit = pa.struct([("b", pa.int32()), ("e", pa.int32())]), pa.struct([("item_id", pa.string()), ("word", pa.int32())])
    cols = {"shard": pa.array([row["shard"]] * n_docs, pa.int64()), "place": pa.array(range(n_docs), pa.int32()),
            "doc_id": pa.array(row["doc_id"], pa.int64()), "text_hash": pa.array(row["text_hash"], pa.int64()),
            "n_words": pa.array(n_words), "runs": pa.array(runs, pa.list_(run)),
            "items": pa.array(items, pa.list_(pa.string())), "near": pa.array(near, pa.list_(hit))}
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


# ---------------------------------------------------------------- the jobs

def _counts(index: DataFrame, q: Queries) -> np.ndarray:
    """Corpus-wide counts of the block's terms, one number a term."""
    shared = index.sparkSession.sparkContext.broadcast(q.vocab)

    def one(b):
        total = np.zeros(len(shared.value), np.int64)
        for k in range(b.num_rows):
            at = pc.index_in(shared.value, value_set=b.column("terms")[k].values).to_numpy(zero_copy_only=False)
            there = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), bool)
            n = np.diff(np.frombuffer(b.column("starts")[k].as_py(), "<i4"))
            total[there] += n[at[there].astype(np.int64)]
        own = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["term", "n"])

    got = map_batches(index.select("terms", "starts"), one, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(q.vocab), np.int64)
    for term, n in got.toLocalIterator():
        counts[term] = n
    return counts


def _n_blocks(benchmark: DataFrame) -> int:
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string")) + 64), F.lit(0))).first()[0]
    return int(size // BLOCK_BYTES) + 1


def _block(benchmark: DataFrame, n: int, k: int) -> Queries:
    """One of ``n`` blocks of the query set."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    b = b if n == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
    return Queries([tuple(r) for r in b.collect()])


def _asked(index: DataFrame, q: Queries) -> DataFrame:
    q.rank(_counts(index, q))
    shared = index.sparkSession.sparkContext.broadcast(q)

    def one(b):
        for k in range(b.num_rows):
            row = {c: b.column(c)[k].as_py() for c in ("shard", "doc_id", "text_hash", "n_words", "starts", "positions")}
            yield _search(row, b.column("terms")[k].values, shared.value)

    return _each(index, one, MATCHES)


def matches(index: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document of a stored index: ``runs``, the stretches of words (from ``b``, before ``e``) hit by exact phrases;
    ``items``, those with one; ``near``, the items with a proximity match and the word at which its first stretch begins."""
    n, parts = _n_blocks(benchmark), None
    if n == 1:
        return _asked(index, _block(benchmark, 1, 0))
    for k in range(n):
        part = staged(_asked(index, _block(benchmark, n, k)), "decontam-matches")
        parts = part if parts is None else parts.unionByName(part)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  one list per block
    return parts.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"),
                                               F.first("n_words").alias("n_words"), flat("runs"), flat("items"), flat("near"))


def judged(found: DataFrame) -> DataFrame:
    """The verdicts of :func:`matches`."""
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    step = lambda s, r: F.struct((s["hit"] + F.greatest(F.lit(0), r["e"] - F.greatest(r["b"], s["end"]))).alias("hit"),
                                 F.greatest(s["end"], r["e"]).alias("end"))
    ids, near = F.array_sort(F.array_distinct("items")), F.array_sort("near")
    found = found.select("doc_id", "text_hash", "n_words", F.aggregate(F.array_sort("runs"), start, step, lambda s: s["hit"].cast("bigint")).alias("n_hit"),
                         ids.alias("items"), near.alias("near"))
    first = F.filter("near", lambda x, i: (i == 0) | (F.get("near", i - 1)["item_id"] != x["item_id"]))
    found = found.withColumn("near", first)
    listed = F.array_join(F.transform("near", lambda x: F.concat(x["item_id"], F.lit(":"), x["word"].cast("string"))), ",")
    return found.select(
        "doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.size(F.array_except(F.transform("near", lambda x: x["item_id"]), "items")).cast("bigint").alias("n_near_items"),
        F.sha2(listed.cast("binary"), 256).alias("near_sha256"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Of every document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, ``n_near_items`` (items with a
    proximity match and no exact one) and ``near_sha256`` (of ``item_id:word`` of all items with a proximity match)."""
    return judged(matches(stored_index(docs), benchmark)).drop("text_hash")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text_hash`` of the contaminated documents, each once."""
    return judged(matches(stored_index(docs), benchmark)).where("contaminated").select("doc_id", "text_hash").distinct()
