"""Alignment of two tokenizers' ids over the same text, and how often ids are linked corpus-wide.

``A`` is a byte-level vocabulary that reads a blank and the text, ``B`` a piece vocabulary that puts the blank there
itself; both then spell the same bytes.  After full tokenisation the byte ends both share before a token that is
marked by a blank on both sides are anchors: they split a document into windows of token ids.  A window is
aligned by its byte ends once and remembered by its two id tuples (numbered in Arrow, so a window met again costs a
look-up); chained, the windows give the document's groups and links.

Links are counted corpus-wide from each document's distinct id pairs.  A pair with at least 1/``HOT`` of all
links is one of at most ``HOT`` such pairs, whatever the corpus: these go to every task.  The others are rare, so
their shuffle join has no hot key.

Defined results: a text that is null or empty, or that a vocabulary does not spell back byte for byte (U+2581 in the
text), has no tokens; rows with an equal ``doc_id`` count each on their own; extra columns are ignored; an empty
table gives no rows.  A long text is read in stretches of about ``STRETCH`` characters, cut where no token can reach over,
so memory does not grow with its tokens' objects.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import map_batches, staged, texts
from .wordwise import Memo, chain, numbered, pieces_of, ragged

HOT = 1 << 18
STRETCH = 2 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")                # a single blank between others: neither vocabulary reaches over it
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_OPEN = f" {_WHITE}|{_WHITE} |^{_WHITE}|{_WHITE}$"   # white space that a cut at every blank would change
#: Words that the rank file of a byte-level vocabulary surely encodes alike: Latin, no white space at the ends.
_LATIN = re.compile("[!-~\u00a1-\u024f\u2010-\u2027](?:[\\n!-~\u00a1-\u024f\u2010-\u2027]*[!-~\u00a1-\u024f\u2010-\u2027])?")
CHUNK = 2000                                       # words encoded as one text


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Side:
    """One vocabulary: word -> ids (remembered), and per id its number of bytes, its bytes and whether a blank marks it."""

    def __init__(self, encode, spelled: list[bytes], remembered: int = 200_000, tokenizer=None):
        self.tokenizer = tokenizer
        if len(spelled) > 1 << 16:
            raise ValueError("windows are keyed by 16-bit ids")
        self.ids = Memo(lambda words: self._checked(words, encode(words)), size=remembered)
        self.spelled = spelled
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.marked = np.array([x.startswith(b" ") for x in spelled])

    def _checked(self, words: list[str], ids: list[bytes]) -> list[bytes]:
        """The words' ids; none where their bytes do not give a blank and the word."""
        want, flat = [b" " + w.encode() for w in words], np.frombuffer(b"".join(ids), "<u4")
        got = b"".join(map(self.spelled.__getitem__, flat.tolist()))
        upto = np.concatenate([[0], np.cumsum(self.size[flat])])
        ends = upto[np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)]
        if got == b"".join(want) and np.array_equal(ends, np.cumsum(np.fromiter(map(len, want), np.int64, len(want)))):
            return ids
        starts = np.concatenate([[0], ends[:-1]])
        return [x if got[s:e] == w else b"" for x, s, e, w in zip(ids, starts.tolist(), ends.tolist(), want, strict=True)]


def _packed(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


def byte_level(path: str, special: bool = False, remembered: int = 200_000) -> Side:
    """The byte-level vocabulary.  Where it lies beside as ranks, Latin words are encoded from these, many as one
    text (no token reaches over a blank), and told apart by their bytes; tests compare the ids.  With ``special`` the
    tokenizer knows special tokens in a text (words must not hold any then)."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = not special
    alphabet = _byte_alphabet()
    spelled = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
               for t in map(tok.id_to_token, range(tok.get_vocab_size()))]
    size = np.array([len(x) for x in spelled], np.int64)
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return Side(lambda words: [_packed(e.ids) for e in tok.encode_batch_fast([" " + w for w in words], add_special_tokens=False)],
                    spelled, remembered, tok)
    import base64

    import public_tokenizers
    import tiktoken
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    many = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(words: list[str]) -> list[bytes]:
        out: list = [None] * len(words)
        latin = [k for k, w in enumerate(words) if _LATIN.fullmatch(w)]
        for s in range(0, len(latin), CHUNK):
            part = latin[s:s + CHUNK]
            ids = np.array(many(" " + " ".join([words[k] for k in part])), "<u4")
            ends = np.cumsum(size[ids])
            stop = np.searchsorted(ends, np.cumsum([len(words[k].encode()) + 1 for k in part])) + 1
            data, start = ids.tobytes(), 0
            for k, e in zip(part, (4 * stop).tolist(), strict=True):
                out[k] = data[start:e]
                start = e
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, tok.encode_batch_fast([" " + words[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = _packed(e.ids)
        return out

    return Side(encode, spelled, remembered, tok)


def piece_level(path: str) -> Side:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any("▁" in p.lstrip("▁") for p in pieces):
        raise ValueError("the piece vocabulary has pieces that reach over a blank")
    spelled = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Side(lambda words: list(map(_packed, sp.encode(words, num_threads=1))), spelled)


def _decimals() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every 16-bit id as decimal digits and one more byte: all bytes, each one's start and length."""
    text = [b"%d," % k for k in range(1 << 16)]
    size = np.array([len(x) for x in text], np.int64)
    return np.frombuffer(b"".join(text), np.uint8), np.cumsum(size) - size, size


def align(keys: list[bytes], size_a: np.ndarray, size_b: np.ndarray, decimals) -> list[bytes]:
    """Windows (number of A ids in two words, A ids, B ids, 16 bits each) to their links and groups.

    A group ends where tokens of both sides end; the two that end it are a link (``a << 16 | b``).  Returned per window:
    its number of links and the links, 32 bits each, then the groups as text.  Both sides of a window have the same
    bytes, so many windows are aligned as one."""
    digits, place, width = decimals
    words = np.fromiter(map(len, keys), np.int64, len(keys)) // 2
    flat = np.frombuffer(b"".join(keys), "<u2").astype(np.int64)
    head = np.cumsum(words) - words
    na = flat[head] << 16 | flat[head + 1]
    nb = words - 2 - na
    a, b = flat[ragged(head + 2, na)], flat[ragged(head + 2 + na, nb)]
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    both = np.zeros(int(ends_a[-1]) + 1, np.uint8)
    both[ends_a] = 1
    both[ends_b] += 2
    last_a, last_b = both[ends_a] == 3, both[ends_b] == 3
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    in_a, in_b = np.bincount(group_a), np.bincount(group_b)
    at_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
    at_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a], mark[at_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    text = digits[ragged(place[ids], width[ids])]
    upto = np.cumsum(width[ids])
    text[upto - 1] = mark
    text = text.tobytes()
    link = (a[last_a] << 16 | b[last_b]).astype("<u4").tobytes()
    n = np.bincount(np.repeat(np.arange(len(keys)), na)[last_a], minlength=len(keys))
    stop_link, stop_text = (4 * np.cumsum(n)).tolist(), upto[np.cumsum(na + nb) - 1].tolist()
    out, x, y = [], 0, 0
    for count, lx, ly in zip(n.astype("<u4"), stop_link, stop_text, strict=True):
        out.append(count.tobytes() + link[x:lx] + text[y:ly - 1])
        x, y = lx, ly
    return out


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = byte_level(byte_path), piece_level(piece_path)
        decimals = _decimals()
        self.windows = Memo(lambda keys: align(keys, self.a.size, self.b.size, decimals), size=200_000, longest=160)

    def stretch(self, words: pa.Array, counts: np.ndarray):
        """Texts given as words (all texts' words in one array, ``counts`` per text).

        Per text: whether its bytes come back, numbers of tokens, its windows; and the windows' groups and links."""
        distinct, index = numbered(words)
        va, vb = self.a.ids(distinct), self.b.ids(distinct)
        a, la = chain(va, index, "<u4")
        b, lb = chain(vb, index, "<u4")
        text = np.repeat(np.arange(len(counts)), counts)                          # of every word
        ta, tb = np.repeat(text, la), np.repeat(text, lb)
        n = len(counts)
        na, nb = np.bincount(ta, minlength=n), np.bincount(tb, minlength=n)
        none = np.array([not x or not y for x, y in zip(va, vb, strict=True)], bool)   # a word that does not come back
        bad = np.bincount(text, none[index], n) > 0
        if bad.any():
            rest = self.stretch(words.filter(pa.array(np.repeat(~bad, counts))), np.where(bad, 0, counts))
            return (~bad, *rest[1:])
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        # anchors: a shared end, the next token on both sides marked by a blank
        next_a = np.append(self.a.marked[a][1:], True) if len(a) else np.zeros(0, bool)
        next_b = np.append(self.b.marked[b][1:], True) if len(b) else np.zeros(0, bool)
        both = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, np.uint8)
        both[ends_a[next_a]] = 1
        both[ends_b[next_b]] += 2
        ia, ib = np.flatnonzero(both[ends_a] == 3) + 1, np.flatnonzero(both[ends_b] == 3) + 1
        starts_a, starts_b = np.concatenate([[0], ia])[:-1].astype(np.int64), np.concatenate([[0], ib])[:-1].astype(np.int64)
        wa, wb = ia - starts_a, ib - starts_b
        of = ta[starts_a]
        # the windows' keys: number of A ids, A ids, B ids, two bytes each
        width = 2 + wa + wb
        at = np.cumsum(width) - width
        flat = np.empty(int(width.sum()), "<u2")
        flat[at], flat[at + 1] = wa >> 16, wa & 0xFFFF
        flat[ragged(at + 2, wa)] = a[ragged(starts_a, wa)]
        flat[ragged(at + 2 + wa, wb)] = b[ragged(starts_b, wb)]
        offsets = np.concatenate([[0], np.cumsum(2 * width)]).astype(np.int64)
        keys = pa.Array.from_buffers(pa.large_binary(), len(width), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        different, number = numbered(keys)
        found = self.windows(different)
        flat = np.frombuffer(b"".join(found), np.uint8)
        size = np.fromiter(map(len, found), np.int64, len(found))
        head = np.cumsum(size) - size
        n_links = flat[ragged(head, np.full(len(head), 4))].view("<u4").astype(np.int64)
        link = flat[ragged(head + 4, 4 * n_links)].view("<u4")
        pair = link[ragged((np.cumsum(n_links) - n_links)[number], n_links[number])].astype(np.int64)
        return (~bad, na, nb, of, number, [x[4 + 4 * k:] for x, k in zip(found, n_links.tolist(), strict=True)],
                pair, n_links[number])


def _add(aligner: Aligner, documents: list[_Document], words: pa.Array, counts: np.ndarray) -> None:
    """Align one stretch of every document (all words in one array, ``counts`` of them each), and add what it gives."""
    n = len(counts)
    ok, na, nb, of, number, groups, pair, each = aligner.stretch(words, counts)
    key = np.sort(np.repeat(of, each) << 32 | pair)
    head = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(head, len(key)))
    key = key[head]
    lo, at = np.searchsorted(key >> 32, np.arange(n + 1)), np.searchsorted(of, np.arange(n + 1))
    key &= (1 << 32) - 1
    for k, d in enumerate(documents):
        mine = b";".join(map(groups.__getitem__, number[at[k]:at[k + 1]].tolist()))
        d.add(bool(ok[k]), int(na[k]), int(nb[k]), mine, key[lo[k]:lo[k + 1]], times[lo[k]:lo[k + 1]])


@lru_cache(maxsize=2)
def _aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def _stretches(text: str):
    """Lists of words of about ``STRETCH`` characters: the text in parts cut at a blank no token reaches over."""
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + STRETCH) if len(text) - start > STRETCH else None
        yield _CUT.split(text[start:cut.start()] if cut else text[start:])
        if cut is None:
            return
        start = cut.end()


class _Document:
    """What a document's stretches add up to."""

    __slots__ = ("ok", "n", "sha", "pairs")

    def __init__(self):
        self.ok, self.n, self.sha, self.pairs = True, [0, 0, 0], hashlib.sha256(), []

    def add(self, ok: bool, na: int, nb: int, groups: bytes, pairs: np.ndarray, times: np.ndarray) -> None:
        self.ok &= ok
        self.sha.update(b";" + groups if self.n[0] and groups else groups)
        self.n[0] += na
        self.n[1] += nb
        self.n[2] += int(times.sum())
        self.pairs.append((pairs, times))

    def row(self) -> tuple:
        if not self.ok or not self.n[0]:
            return 0, 0, 0, 0, "", [], []
        if len(self.pairs) == 1:
            pairs, times = self.pairs[0]
        else:
            pairs, back = np.unique(np.concatenate([p for p, _ in self.pairs]), return_inverse=True)
            times = np.bincount(back, np.concatenate([t for _, t in self.pairs])).astype(np.int64)
        return self.n[0], self.n[1], self.n[2], self.n[2], self.sha.hexdigest(), pairs, times


def links(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """``rid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and the distinct id pairs (``a << 16 | b``) with their links."""
    paths = vocabularies or default_vocabularies()
    names = ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches):
        rid = TaskContext.get().partitionId() << 33
        for b in batches:
            aligner = _aligner(*paths)
            ids, col = b.column(0).to_pylist(), b.column(1)
            for start, end in pieces_of(col, STRETCH):
                found = [_Document() for _ in range(start, end)]
                part = pc.cast(col.slice(start, end - start), pa.large_string())
                plain = pc.fill_null(pc.and_(pc.invert(pc.match_substring_regex(part, _OPEN)),
                                             pc.and_(pc.greater(pc.binary_length(part), 0),
                                                     pc.less(pc.binary_length(part), STRETCH))), False)
                words = pc.split_pattern(part.filter(plain), " ")                # cut at every blank, in Arrow
                plain = plain.to_pylist()
                if len(words):
                    _add(aligner, [d for d, p in zip(found, plain, strict=True) if p], words.flatten(), np.diff(np.asarray(words.offsets)))
                active = [(d, _stretches(col[k].as_py() or "")) for k, (d, p) in enumerate(zip(found, plain, strict=True), start) if not p]
                while active:                               # one stretch of every other text, then the next of the longer ones
                    read = [(d, g, w) for d, g in active if (w := next(g, None)) is not None]
                    active = [(d, g) for d, g, _ in read]
                    if read:
                        _add(aligner, [d for d, _, _ in read], pa.array([x for _, _, w in read for x in w], pa.large_string()),
                             np.array([len(w) for _, _, w in read], np.int64))
                rows = [d.row() for d in found]
                c = list(zip(*rows, strict=True))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(rid, rid + n), pa.int64()), pa.array(ids[start:end], pa.int64()),
                     *[pa.array(x, pa.int64()) for x in c[:4]], pa.array(c[4], pa.string()),
                     pa.array(c[5], pa.list_(pa.int64())), pa.array(c[6], pa.list_(pa.int32()))], names)
                rid += n

    ship_package(docs.sparkSession)
    return texts(docs).mapInArrow(run, "rid bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                                       "groups_sha256 string, pairs array<bigint>, times array<int>")


def pair_counts(linked: DataFrame) -> DataFrame:
    """``pair, links, best``: corpus-wide links of every id pair, and whether no pair of its B id has more."""
    counts = staged(linked.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
                    .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("links")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFF))
    top = staged(counts.groupBy(b.alias("b")).agg(F.max("links").alias("top")), "pair-tops")   # one row per B id
    return counts.join(top, b == F.col("b")).select("pair", "links", (F.col("links") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, vocabularies: tuple[str, str] | None = None, hot: int | None = None) -> DataFrame:
    """Per document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``."""
    hot = HOT if hot is None else hot
    spark = docs.sparkSession
    linked = staged(links(docs, vocabularies), "linked")
    counted = staged(pair_counts(linked), "pairs")
    total = counted.agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0]
    least = -(-total // hot)
    often = counted.where(F.col("links") >= least).orderBy("pair").toArrow()      # at most `hot` rows
    shared = spark.sparkContext.broadcast(tuple(np.asarray(often.column(x)) for x in ("pair", "links", "best")))

    def known(b):
        pair, n, best = shared.value
        p, t = b.column(b.schema.get_field_index("pairs")), b.column(b.schema.get_field_index("times"))
        off = np.asarray(p.offsets).astype(np.int64)
        off -= off[0]
        key, times = np.asarray(p.flatten()), np.asarray(t.flatten()).astype(np.int64)
        if len(pair):
            at = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
            hit = pair[at] == key
            good, weight = np.where(hit, times * best[at], 0), np.where(hit, times * n[at], 0)
        else:
            hit, good, weight = np.zeros(len(key), bool), 0 * times, 0 * times

        def per_row(x):
            upto = np.concatenate([[0], np.cumsum(x)])
            return upto[off[1:]] - upto[off[:-1]]

        left = np.concatenate([[0], np.cumsum(per_row(~hit))]).astype(np.int32)
        names = ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        return pa.RecordBatch.from_arrays(
            [*[b.column(b.schema.get_field_index(x)) for x in names], pa.array(per_row(good)), pa.array(per_row(weight)),
             pa.ListArray.from_arrays(pa.array(left), pa.array(key[~hit])),
             pa.ListArray.from_arrays(pa.array(left), pa.array(times[~hit]))],
            [*names, "n_best", "count_sum", "pairs", "times"])

    part = map_batches(linked, known, "rid bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                       "groups_sha256 string, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>")
    seldom = (part.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
              .select("rid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")))
    rest = (seldom.join(counted.where(F.col("links") < least), "pair").groupBy("rid")
            .agg(F.sum(F.col("times") * F.col("best").cast("bigint")).alias("best2"), F.sum(F.col("times") * F.col("links")).alias("sum2")))
    zero = F.lit(0).cast("bigint")
    return (part.drop("pairs", "times").join(rest, "rid", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("best2", zero)).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("sum2", zero)).alias("count_sum"), "groups_sha256"))
