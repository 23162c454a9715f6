"""Vector packing, token alignment and lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearth.llm import lexical_search, token_alignment, vector_packing, wordwise
from hearth.llm.vector_packing import Limits, place

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string"
CLASH = ", length bigint, block string, query int, pair string, rank int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, None, 7, "p", 0) for r in rows], DOC + CLASH).repartition(parts)


EDGE = [(None, "no id here"), (1, None), (2, ""), (3, "same text here"), (3, "same text here"), (3, "other text"),
        (4, "w " * 30_000), (5, "   "), (6, " a  b\n\n c\t"), (7, "x<|endoftext|>y <s> </s>"), (8, "▁ mark"), (9, "é 日本 ﬁ   \x00 end "),
        (2**62 + 1, "large id"), (11, "don't  stop it's I'LL 1234 ΑΣ Σ")]


def plain(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# ------------------------------------------------------------------ wordwise

def test_memo_gives_what_encoding_gives_and_stays_bounded():
    asked = Counter()

    def encode(keys):
        asked.update(keys)
        return [k * 2 for k in keys]

    memo = wordwise.Memo(encode, size=8, longest=3)
    rng = random.Random(1)
    for _ in range(200):
        keys = [rng.choice("abcdefghijklm") * rng.randint(1, 5) for _ in range(rng.randint(0, 9))]
        keys = list(dict.fromkeys(keys))
        assert memo(keys) == [k * 2 for k in keys]
        assert len(memo.new) + len(memo.old) < 30 and max(map(len, [*memo.new, ""])) <= 3


# ------------------------------------------------------------------ op11

@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 20), Limits(8, 2, 1), Limits(256, 100, 256), Limits(1, 1, 1)])
def test_place_holds_all_limits_and_pads_nothing(limits):
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 200):
        length = rng.integers(1, limits.tokens + 1, n)
        prompt = np.minimum(length, rng.integers(0, limits.tokens + 1, n))
        seen = [np.zeros(x, int) for x in length]
        for seq in place(length, prompt, limits):
            total = sum(e - s for _, s, e in seq)
            assert 0 < total <= limits.tokens and total & (total - 1) == 0 and len(seq) <= limits.segments
            assert sum(max(0, e - max(s, prompt[k])) for k, s, e in seq) <= limits.loss
            for k, s, e in seq:
                seen[k][s:e] += 1
        assert all((x == 1).all() for x in seen)


def test_dot_product_decides():
    # room is even, so the piece with tokens and loss wins over the longer one without loss
    out = place(np.array([60, 50, 4]), np.array([60, 0, 0]), Limits(64, 8, 64))
    assert out[0][0][0] == 1


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = EDGE + plain(spark)
    got = vector_packing.pack(frame(spark, rows)).collect()
    ids = [(d, tok.encode(t or "", add_special_tokens=False).ids + [2]) for d, t in rows]
    want = Counter()
    mine = {}
    for r in got:
        mine.setdefault(r.doc_id, []).append(r)
    for d, x in ids:
        want[d] += len(x)
    assert {d: sum(r.length for r in v) for d, v in mine.items()} == dict(want)
    single = {d for d, n in Counter(d for d, _ in rows).items() if n == 1}
    for d, x in ids:
        if d in single:
            at = 0
            for r in sorted(mine[d], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(x)
                assert r.ids_crc32 == zlib.crc32(np.array(x[at:at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(x)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    padded = 0
    for v in by.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and len(v) <= 128
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded == 0


def test_packing_instruction_data_by_keys(spark):
    conv = spark.createDataFrame(
        [(1, 0, "user", "What is it?"), (1, 1, "assistant", "It is this."), (1, 2, "user", None), (1, 3, "assistant", "Yes."),
         (2, 1, "assistant", "alone"), (None, 1, "assistant", "no id"), (3, 0, "user", "never answered")],
        "conv_id bigint, turn bigint, role string, text string")
    ex = vector_packing.instruction_examples(conv)
    assert {(r.conv_id, r.turn): r.prompt for r in ex.collect()} == {
        (1, 1): "What is it?", (1, 3): None, (2, 1): None, (None, 1): None}
    got = vector_packing.pack(ex, limits=Limits(16, 2, 6), keys=("conv_id", "turn")).collect()
    for key in ((1, 1), (1, 3), (2, 1), (None, 1)):
        mine = [r for r in got if (r.conv_id, r.turn) == key]
        assert sum(r.length for r in mine) == mine[0].doc_tokens
    first = [r for r in got if (r.conv_id, r.turn) == (1, 1)]
    assert sum(r.loss_tokens for r in first) == 5 and sum(r.length for r in first) == 9      # It is this . end
    for q in {r.sequence_id for r in got}:
        v = [r for r in got if r.sequence_id == q]
        assert len(v) <= 2 and sum(r.loss_tokens for r in v) <= 6 and sum(r.length for r in v) <= 16
    with pytest.raises(ValueError):
        Limits(100)


def test_word_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(8)
    bits = ["The", "the,", "end.", "İstanbul", "ﬁne", "e\u0301", "straße.", "ΑΣ", "<|endoftext|>", "<|ENDOFTEXT|>", "I'll", "a.b", "..", "x. ", "\n", "  ",
            "\u00a0", "\u3000", "12,", "日本.", "ÀÉ", "word ,", "q\u0085r", "\t", "\u1680"]
    for special in (True, False):
        texts = [" ".join(x for x in rng.choices(bits, k=rng.randint(0, 40)) if special or "<" not in x) for _ in range(300)] + [None, ""]
        col = pa.array(texts, pa.string()).slice(3)
        ids, n = vector_packing.token_ids(col, path)
        at = np.concatenate([[0], np.cumsum(n)])
        for k, t in enumerate(texts[3:]):
            assert ids[at[k]:at[k + 1]].tolist() == tok.encode(t or "", add_special_tokens=False).ids, t


def test_packing_empty(spark):
    assert vector_packing.pack(frame(spark, [])).collect() == []


# ------------------------------------------------------------------ op12

def brute_alignment(rows):
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=p.path("piece_bpe_32k.model"))
    alphabet = token_alignment._byte_alphabet()
    out, pairs, linked = [], Counter(), []
    for d, t in rows:
        if not t:
            out.append((d, 0, 0, 0, 0, ""))
            linked.append([])
            continue
        a, b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        ab = [bytes(alphabet[c] for c in tok.id_to_token(x)) for x in a]
        bb = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not b"".join(ab) == b"".join(bb) == (" " + t).encode():
            out.append((d, 0, 0, 0, 0, ""))
            linked.append([])
            continue
        ea, eb = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        both = sorted(set(ea) & set(eb))
        links = [(x, y) for x, e in zip(a, ea, strict=True) if e in set(both) for y, f in zip(b, eb, strict=True) if e == f] \
            if len(a) < 2000 else [(a[ea.index(e)], b[eb.index(e)]) for e in both]
        groups, s = [], 0
        for e in both:
            groups.append(",".join(str(x) for x, z in zip(a, ea, strict=True) if s < z <= e) + "|" +
                          ",".join(str(y) for y, z in zip(b, eb, strict=True) if s < z <= e)) if len(a) < 2000 else None
            s = e
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if len(a) < 2000 else None
        out.append((d, len(a), len(b), len(both), len(links), sha))
        linked.append(links)
        pairs.update(links)
    top = {}
    for (_, b), n in pairs.items():
        top[b] = max(top.get(b, 0), n)
    return [(*o[:5], sum(pairs[x] == top[x[1]] for x in li), sum(pairs[x] for x in li), o[5]) for o, li in zip(out, linked, strict=True)]


@pytest.mark.parametrize("hot", [None, 40, 1])               # all pairs broadcast, some, none
def test_alignment_matches_brute_force(spark, hot):
    rows = EDGE + [(d, t) for d, t in plain(spark) if len(t or "") < 4000][:60]
    got = token_alignment.align_documents(frame(spark, rows), hot=hot).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:7])          # noqa: E731
    got = sorted((tuple(r) for r in got), key=key)
    want = sorted(brute_alignment(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7]
        assert w[7] is None or g[7] == w[7]


def test_long_text_in_stretches_gives_the_same(monkeypatch):
    text = "".join(random.Random(4).choice(["the ", "cat's ", "  ", "été\n", "12 ", ". "]) for _ in range(3000)) + "end"
    al = token_alignment._aligner(*token_alignment.default_vocabularies())

    def row(stretch):
        monkeypatch.setattr(token_alignment, "STRETCH", stretch)
        d, parts = token_alignment._Document(), list(token_alignment._stretches(text))
        for w in parts:
            token_alignment._add(al, [d], pa.array(w, pa.large_string()), np.array([len(w)]))
        x = d.row()
        return len(parts), x[:5], list(map(int, x[5])), list(map(int, x[6]))

    whole, cut = row(1 << 20), row(50)
    assert whole[0] == 1 and cut[0] > 50 and whole[1:] == cut[1:]
    brute = brute_alignment([(1, text)])[0]
    assert whole[1][:3] == brute[1:4]


def test_windows_are_remembered_by_their_ids():
    al = token_alignment.Aligner(*token_alignment.default_vocabularies())
    calls = []
    inner = al.windows.encode
    al.windows.encode = lambda keys: calls.append(len(keys)) or inner(keys)
    d = token_alignment._Document()
    token_alignment._add(al, [d], pa.array(["the", "cat", "the", "cat"]), np.array([4]))
    token_alignment._add(al, [d], pa.array(["the", "cat"]), np.array([2]))
    assert sum(calls) == 2 and d.n[2] == 6


def test_alignment_empty(spark):
    assert token_alignment.align_documents(frame(spark, [])).collect() == []


# ------------------------------------------------------------------ op13

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k=10):
    vec = [(d, Counter(w.translate(LOWER) for w in TERM.findall(t or ""))) for d, t in docs]
    big_n, big_l = sum(1 for _, v in vec if v), sum(sum(v.values()) for _, v in vec)
    df = Counter(w for _, v in vec for w in v)
    out = []
    for i, t in items:
        scores = []
        terms = [w.translate(LOWER) for w in TERM.findall(t or "")]
        for d, v in vec:
            if v:
                m = 100 - 75 + (75 * sum(v.values()) * big_n) // big_l
                s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * ((1000000000 * v[w]) // (1000 * v[w] + 8 * m))
                        for w in terms if w in v)
                if s > 0:
                    scores.append((-s, d is None, d or 0))
        out += [(i, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("first,block", [(4096, None), (8, 600)])
def test_search_matches_brute_force(spark, first, block, monkeypatch):
    monkeypatch.setattr(lexical_search, "FIRST", first)
    docs = plain(spark) + EDGE + [(900 + k, "Same Passage of ties, twice twice") for k in range(25)]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(901, None), (902, ""), (903, "zzzz unseen"), (904, "passage TIES ties"), (904, "passage TIES ties"), (None, "twice été 日本"),
              (905, "same text here"), (906, " ".join(["w"] * 50))]
    it = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id bigint, text string, rank int, query int")
    got = lexical_search.search(frame(spark, docs), it, block_bytes=block).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_search(docs, items)


def test_search_skips_buckets_and_bounds_rows(monkeypatch):
    """Buckets are skipped and rows discarded by bounds, and no result changes."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    docs = [" ".join(rng.choice(words, rng.integers(1, 60) if k % 50 else 80)) for k in range(3000)]
    docs[7] = " ".join(words[:20])
    items = [" ".join(words[:20]), " ".join(words[5:40])]
    q = lexical_search.queries(items)
    n, key, freq = lexical_search._count([d.encode() for d in docs], q.vocabulary)
    off = pa.array(np.searchsorted(key >> 32, np.arange(len(docs) + 1)), pa.int32())
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(docs)), pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(off, pa.array((key & 0xFFFFFFFF).astype(np.int32))),
         pa.ListArray.from_arrays(off, pa.array(freq, pa.int64()))], ["doc_id", "n", "terms", "freqs"])
    df = Counter((key & 0xFFFFFFFF).tolist())
    monkeypatch.setattr(lexical_search, "BUCKET", 64)
    met = []
    inner = lexical_search.Search._bounded

    def watched(self, *a):
        out = inner(self, *a)
        met.append((len(a[-1]), len(out)))
        return out

    monkeypatch.setattr(lexical_search.Search, "_bounded", watched)
    s = lexical_search.Search.of(q, df, len(docs), int(n.sum()))
    got = sorted((k, d, x) for k, d, x in s.run([batch], 10))
    want = sorted((i, d, s) for i, r, d, s in brute_search(list(enumerate(docs)), list(enumerate(items))))
    assert got == want
    assert sum(x for x, _ in met) < 2 * len(docs) and sum(y for _, y in met) < 0.7 * sum(x for x, _ in met)


def test_long_text_is_counted_in_parts(spark, monkeypatch):
    text = "alpha beta " * 700_000 + "Gamma"
    r = lexical_search.term_vectors(frame(spark, [(1, text)]), {b"beta": 0, b"gamma": 1, b"delta": 2}).first()
    assert (r.n, list(r.terms), list(r.freqs)) == (1_400_001, [0, 1], [700_000, 1])


def test_search_empty(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "text")], "item_id bigint, text string")
    assert lexical_search.search(frame(spark, EDGE), none).collect() == []
    assert lexical_search.search(frame(spark, []), some).collect() == []
