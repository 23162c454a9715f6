"""Pseudonyms of long and adjoining values, and word-wise ids against the tokenizer."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from hearth.llm import packing, pii


def test_no_character_of_a_wide_local_part_stays():
    rng = random.Random(3)
    same = 0
    for _ in range(40):
        local = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCXYZ0123456789") for _ in range(64))
        new, spans = pii.replace(f"write to {local}@host.org now", b"k")
        assert spans == [(9, 9 + 64 + 9, "email")]
        got = new[9:73]
        assert pii.replace(new, b"k", back=True)[0] == f"write to {local}@host.org now"
        same += sum(x == y for x, y in zip(local, got, strict=True))
        assert all(a.isdigit() == b.isdigit() and a.isupper() == b.isupper() for a, b in zip(local, got, strict=True))
    assert same < 40 * 64 * 0.1                                     # about one in 26 by chance


@pytest.mark.parametrize("bits", [100, 260, 2000, 40_000])
def test_feistel_of_any_width_is_a_permutation_of_all_bits(bits):
    rng = random.Random(bits)
    size = (1 << bits) - rng.getrandbits(bits // 2)
    changed = 0
    for _ in range(12):
        x = rng.randrange(size)
        y = pii.feistel(x, size, b"key", "t")
        assert 0 <= y < size and pii.feistel(y, size, b"key", "t", back=True) == x
        changed |= x ^ y
    assert changed >> (bits - 8) and bin(changed).count("1") > bits * 0.95


def test_long_keys_differ_in_every_byte():
    a, b = b"k" * 80, b"k" * 79 + b"x"
    assert [pii.feistel(v, 10**9, a, "t") for v in range(5)] != [pii.feistel(v, 10**9, b, "t") for v in range(5)]


def test_cards_beside_other_digits():
    def kinds(text):
        return [(text[s:e], k) for s, e, k in pii.find(text)]

    card = "4111 1111 1111 1111"
    assert kinds(f"paid with {card} 123 today") == [(card, "card")]
    assert kinds(f"on 2024 {card}") == [(card, "card")] or kinds(f"on 2024 {card}") == [("2024 " + card, "card")]
    assert kinds(f"{card} {card}") == [(card, "card"), (card, "card")]
    assert kinds("3782 822463 10005 9") == [("3782 822463 10005", "card")]
    assert kinds("4111111111111111") == [("4111111111111111", "card")] and kinds("4111111111111112") == []
    assert kinds("1 " * 40) == [] and kinds("9" * 5000) == []


def test_long_runs_take_linear_time():
    for text in ("a%" * 500_000, "1 " * 300_000, "1234 " * 200_000, "x" * 1_000_000 + "@a.de", "." * 500_000 + "@"):
        start = time.time()
        pii.replace(text, b"k")
        assert time.time() - start < 20, text[:10]


def test_the_digest_sums_all_kinds(spark):
    df = spark.createDataFrame([(1, "a@b.org 192.168.0.1 2020-02-03", 5), (2, None, 5), (3, "none", 5)], "doc_id bigint, text string, n_values int")
    got = {r.doc_id: r for r in pii.digest(pii.pseudonymise(df, b"k")).collect()}
    assert (got[1].n_values, got[2].n_values, got[3].n_values) == (3, 0, 0) and got[1].n_email == 1


def test_byte_level_ids_are_the_tokenizers():
    from tokenizers import Tokenizer
    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    rng = random.Random(8)
    bits = ["The", "the,", "end.\nNext", "İstanbul", "ﬁne", "é", "<|endoftext|>", "<|x", "I'll", " ", "\n", " ", "a　b", "12,", "日本.",
            "q\u0085r", "\t", " ", "\x1c", "z" * 90, "été", "“quoted”", "­", "​"]
    texts = [" ".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(400)] + [None, "", " ", "a", " a", "a "]
    col = pa.array(texts, pa.string()).slice(2)
    got = list(packing._encoder(path).encode(col))
    for g, t in zip(got, texts[2:], strict=True):
        assert np.frombuffer(g, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids, t
