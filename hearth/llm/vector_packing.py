"""Vector bin packing of token sequences: limits on tokens, segments and loss-bearing tokens at once.

An example is a text, optionally after a ``prompt``: its tokens are both texts' ids and an end mark, its
loss-bearing tokens those after the prompt (all of them without one).  Packed, it is one segment of a
sequence; cut, every piece is one.

Tokenising and packing are one pass without a shuffle: a task packs its pieces in blocks of ``BLOCK``, so memory is
bounded whatever repeats and no step sees the whole corpus.  Inside a block the dot-product heuristic opens a
sequence and takes, until nothing fits, the piece whose vector has the greatest dot product with the room left (each
dimension as a share of its limit).  The room left then is filled by cutting the piece that would have come next; a
sequence that has reached its limit of segments or loss before its tokens ends at the greatest power of two it has
filled, where nothing is padded, and what lies beyond goes back.  A block's last sequence is cut into powers of two.  So
no token is padding, at the price of a few short sequences (at most ``log2 tokens``) a block.

Defined results: null text or prompt is empty (an example of both has the end mark alone); rows with equal keys
are packed each on their own; extra columns, ``prompt`` apart, are ignored; an empty table packs into nothing.
A document of any length is cut; ``sequence_id`` is unique, not consecutive, and the same for the same input files.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .wordwise import Memo, chain, numbered, pieces_of

END = 2
BLOCK = 2048


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold.  ``tokens`` is also the padded length and a power of two."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096

    def __post_init__(self):
        if self.tokens < 1 or self.tokens & (self.tokens - 1) or self.segments < 1 or self.loss < 1:
            raise ValueError("tokens must be a power of two, segments and loss at least 1")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


#: Letters that are surely one pre-token together.
_LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
CHUNK = 2000


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    """Word -> ids.  Words of letters are encoded many as one text: each ends with a token that ends a word."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    ends = np.array([t.endswith("</w>") for t in map(tok.id_to_token, range(tok.get_vocab_size()))])

    def whole(words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(words, add_special_tokens=False)]

    def encode(words: list[str]) -> list[bytes]:
        out: list = [None] * len(words)
        letters = [k for k, w in enumerate(words) if _LETTERS.fullmatch(w)]
        for s in range(0, len(letters), CHUNK):
            part = letters[s:s + CHUNK]
            ids = np.array(tok.encode_batch_fast([" ".join([words[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            stop = np.flatnonzero(ends[ids]) + 1
            if len(stop) == len(part):                   # every word ends once: these are their ends
                data, start = ids.tobytes(), 0
                for k, e in zip(part, (4 * stop).tolist(), strict=True):
                    out[k] = data[start:e]
                    start = e
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, whole([words[k] for k in rest]), strict=True):
            out[k] = x
        return out

    return Memo(encode)


def _spread(texts: pa.Array) -> pa.Array:
    """Line ends and A-Z made blanks and a-z, and a blank put before a full stop or comma between a letter and a blank.

    The vocabulary lowers letters, drops white space and joins neither letters to marks nor anything over white space, so
    the ids stay, and far fewer words differ.  Where a special token's text may stand, nothing is lowered."""
    data, off = _raw(texts)
    if b"<|" not in data.tobytes():
        data = np.where((data >= 65) & (data <= 90), data + 32, data)
    data = np.where(data == 10, 32, data).astype(np.uint8)
    mark = np.flatnonzero((data[1:-1] == 46) | (data[1:-1] == 44)) + 1
    mark = mark[((data[mark - 1] | 32) >= 97) & ((data[mark - 1] | 32) <= 122) & (data[mark + 1] == 32)]
    grown = np.insert(data, mark, 32)
    off = off + np.searchsorted(mark, off)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(grown)])


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and where each text starts and the last ends."""
    texts = pc.cast(texts, pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data and off[-1] > off[0] else np.zeros(0, np.uint8), off - off[0]


def token_ids(col: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in one array, and each text's number of ids (null: empty).

    The vocabulary drops white space and joins nothing over it, so texts are cut at blanks and line ends."""
    words = pc.split_pattern(_spread(pc.fill_null(pc.cast(col, pa.large_string()), "")), " ")
    distinct, index = numbered(words.flatten())
    ids, length = chain(_memo(path)(distinct), index, "<u4")
    upto = np.concatenate([[0], np.cumsum(length)])
    offset = np.asarray(words.offsets)
    return ids, upto[offset[1:] - offset[0]] - upto[offset[:-1] - offset[0]]


def place(length: np.ndarray, prompt: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """The sequences of one block: lists of (piece, first token, end token), in the order they lie in the sequence.

    ``length`` and ``prompt`` describe the pieces; a piece may be cut anywhere."""
    full = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
    source = np.arange(len(length))
    first, last = np.zeros(len(length), np.int64), length.astype(np.int64).copy()
    alive = np.ones(len(length), bool)
    out: list[list[tuple[int, int, int]]] = []

    def loss(k, s, e):
        return np.maximum(0, e - np.maximum(s, prompt[k]))

    def back(k: int, s: int, e: int) -> None:
        """Return a piece's tokens s..e, in the place of one that is used up."""
        nonlocal source, first, last, alive
        free = np.flatnonzero(~alive)
        at = int(free[0]) if len(free) else len(alive)
        if at == len(alive):
            source, first, last = (np.append(x, 0) for x in (source, first, last))
            alive = np.append(alive, False)
        source[at], first[at], last[at], alive[at] = k, s, e, True

    def emit(seq: list[tuple[int, int, int]], upto: int) -> None:
        """Close a sequence after ``upto`` tokens; what lies beyond goes back."""
        kept = []
        for k, s, e in seq:
            n = min(upto, e - s)
            if n:
                kept.append((k, s, s + n))
            if n < e - s:
                back(k, s + n, e)
            upto -= n
        out.append(kept)

    while alive.any():
        idx = np.flatnonzero(alive)
        k, s, e = source[idx], first[idx], last[idx]
        n, bears = e - s, loss(k, s, e)
        shape = np.stack([n / full[0], np.full(len(idx), 1 / full[1]), bears / full[2]])
        open_ = np.ones(len(idx), bool)
        seq: list[tuple[int, int, int]] = []
        tokens, segments, bearing = limits.tokens, limits.segments, limits.loss
        while tokens and segments and open_.any():
            room = np.array([tokens, segments, bearing]) / full
            score = np.where(open_, room @ shape, -1.0)
            fits = open_ & (n <= tokens) & (bears <= bearing)
            if fits.any():
                j = int(np.where(fits, score, -1.0).argmax())
                cut = int(n[j])
            else:                                               # nothing fits whole: cut what comes next
                most = np.minimum(np.minimum(n, tokens), np.maximum(0, prompt[k] - s) + bearing)
                if not (open_ & (most > 0)).any():              # no loss left, and all begin with it
                    break
                j = int(np.where(open_ & (most > 0), score, -1.0).argmax())
                cut = int(most[j])
            seq.append((int(k[j]), int(s[j]), int(s[j]) + cut))
            alive[idx[j]] = open_[j] = False
            tokens -= cut
            segments -= 1
            bearing -= int(loss(k[j], s[j], s[j] + cut))
            if cut < n[j]:
                back(int(k[j]), int(s[j]) + cut, int(e[j]))
                break
        held = limits.tokens - tokens
        if not alive.any():                                     # the block's last: powers of two, nothing goes back
            while held:
                step = 1 << held.bit_length() - 1
                emit(seq, step)
                kept, seq, held = out[-1], [], held - step
                for x in np.flatnonzero(alive):
                    seq.append((int(source[x]), int(first[x]), int(last[x])))
                alive[:] = False
                assert sum(b - a for _, a, b in kept) == step
        else:
            emit(seq, 1 << held.bit_length() - 1)
    return out


class Packer:
    """Packs a stream of examples, block by block; ``rows`` numbers the input rows of the batch at hand."""

    FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset")

    def __init__(self, limits: Limits, task: int):
        self.limits = limits
        self.bits = (BLOCK * limits.tokens).bit_length()         # no block has more sequences than tokens
        self.block = task << 20
        self.pieces: list[tuple] = []                            # key row, start, length, prompt, tokens of the example, ids

    def add(self, key: tuple, ids: bytes, prompt: int) -> None:
        total, width = len(ids) // 4, self.limits.tokens
        for p in range(0, total, width):
            q = min(p + width, total)
            self.pieces.append((key, p, q - p, max(0, min(prompt, q) - p), total, ids[4 * p:4 * q]))

    def full(self) -> bool:
        return len(self.pieces) >= BLOCK

    def flush(self, all_of_it: bool = False):
        """Rows (key, then ``FIELDS``) of the blocks that are full, or of all."""
        while self.pieces and (all_of_it or self.full()):
            block, self.pieces = self.pieces[:BLOCK], self.pieces[BLOCK:]
            length = np.array([x[2] for x in block], np.int64)
            prompt = np.array([x[3] for x in block], np.int64)
            for q, seq in enumerate(place(length, prompt, self.limits)):
                at = 0
                for k, s, e in seq:
                    key, start, _, before, total, ids = block[k]
                    yield (*key, start + s, e - s, zlib.crc32(ids[4 * s:4 * e]), total, max(0, e - max(s, before)),
                           self.block << self.bits | q, at)
                    at += e - s
            self.block += 1


def pack(docs: DataFrame, tokenizer: str | None = None, limits: Limits | None = None,
         keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every piece with its sequence: the integer ``keys``, ``start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset``."""
    limits = limits or Limits()
    path = tokenizer or default_tokenizer()
    has_prompt = "prompt" in docs.columns
    end = np.array([END], "<u4").tobytes()
    names = [*keys, *Packer.FIELDS]
    types = pa.schema([(x, pa.int64()) for x in names])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=types)

    def run(batches):
        packer = Packer(limits, TaskContext.get().partitionId())
        for b in batches:
            for s, e in pieces_of(b.column(0)):
                part = b.slice(s, e - s)
                ids, n = token_ids(part.column(0), path)
                at = np.concatenate([[0], np.cumsum(n)]).tolist()
                pid, pn = token_ids(part.column(1), path) if has_prompt else (ids[:0], np.zeros(part.num_rows, np.int64))
                pat = np.concatenate([[0], np.cumsum(pn)]).tolist()
                key = list(zip(*(part.column(1 + has_prompt + k).to_pylist() for k in range(len(keys))), strict=True))
                rows: list[tuple] = []
                for i in range(part.num_rows):
                    packer.add(key[i], pid[pat[i]:pat[i + 1]].tobytes() + ids[at[i]:at[i + 1]].tobytes() + end,
                               pat[i + 1] - pat[i])
                    if packer.full():
                        rows += packer.flush()
                if rows:
                    yield batch(rows)
        if rows := list(packer.flush(all_of_it=True)):
            yield batch(rows)

    ship_package(docs.sparkSession)
    cols = [F.col(c).cast("string").alias(c) for c in ("text", *["prompt"] * has_prompt)]
    return docs.select(*cols, *[F.col(k).cast("bigint").alias(k) for k in keys]).mapInArrow(
        run, ", ".join(f"`{x}` bigint" for x in names))


def instruction_examples(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, prompt, text``: every assistant turn, with the turn before it as prompt (none: null).

    The turn before is found by its number, not by a window, so a conversation of any size is no group.  Of several
    rows with one number the smallest text is the prompt."""
    c = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                             F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    before = c.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt"))
    return (c.where(F.col("role") == "assistant").join(before, ["conv_id", "turn"], "left")
            .select("conv_id", "turn", "prompt", "text"))
