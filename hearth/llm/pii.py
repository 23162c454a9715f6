"""PII: validated numbers, dates and addresses replaced by format-preserving Feistel pseudonyms.

Each kind of value is validated, mapped to a number inside its format's domain, permuted there by a
keyed balanced Feistel network with cycle walking (a bijection of the domain onto itself), and
written back in the same format.  Equal values become equal pseudonyms in every document and the
pseudonym is valid wherever the original was; with the key the original can be found again.

========  =====================================================  ==========================================
kind      validated by                                           permuted
========  =====================================================  ==========================================
card      13 to 19 digits (groups by blank or hyphen), Luhn       all digits but the first and the check digit
ssn       ddd-dd-dddd, area, group and serial in use              place among all valid numbers
phone     +1 (ddd) ddd-dddd and like forms of 10 or 11 digits     the last seven digits
ipv4      four numbers of 0 to 255                                the address's 32 bits
date      YYYY-MM-DD, 1900 to 2099                                day number
email     local@host.tld, a local part of 64 characters at most   letters and digits of the local part, each in its class
========  =====================================================  ==========================================

A card is a run of digit groups as a whole or, where that is no card (a security code follows), its leftmost, then
longest part in a card's grouping: fours with a shorter end, 4-6-5, or one group.  Not covered: IBANs, IPv6 addresses, dates
other than ISO, phones outside +1, addresses with a longer local part (no valid ones), names and postal addresses.  The
key decides every pseudonym; ``KEY`` is public and for tests, production keys are the caller's.

Defined results: null text stays null, the empty text empty; overlapping matches go to the kind named first in the
table, then leftmost; rows with an equal ``doc_id`` are treated each on their own; columns besides
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

ROUNDS = 8
KEY = b"change-this-key"                         # a parameter of every function; production keys come from the caller
KINDS = ("card", "ssn", "phone", "ipv4", "date", "email")

_PATTERNS = (
    ("card", re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,}(?![\w-])", re.ASCII)),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)),
    ("phone", re.compile(r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)", re.ASCII)),
    ("ipv4", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", re.ASCII)),
    ("date", re.compile(r"(?<![\w-])(?:19|20)\d\d-\d\d-\d\d(?![\w-])", re.ASCII)),
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.ASCII)),
)
_ANY = re.compile(r"\d|@", re.ASCII)


def feistel(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """Keyed permutation of ``range(size)``: Feistel rounds on two halves, walked until inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    key = key if len(key) <= 64 else blake2b(key).digest()
    rounds = range(ROUNDS)[::-1] if back else range(ROUNDS)
    while True:
        left, right = value >> half, value & mask
        for r in rounds:
            x = left if back else right
            f = _draw(r, size, x, tweak, key, half) & mask
            left, right = (right ^ f, left) if back else (right, left ^ f)
        value = left << half | right
        if value < size:
            return value


def _draw(r: int, size: int, x: int, tweak: str, key: bytes, bits: int) -> int:
    """A round's keyed number of at least ``bits`` bits."""
    if bits <= 128:
        return int.from_bytes(blake2b(b"%d:%d:%d:%s" % (r, size, x, tweak.encode()), key=key, digest_size=16).digest())
    said = b"".join(len(v).to_bytes(8) + v for v in (n.to_bytes(n.bit_length() // 8 + 1) for n in (r, size, x))) + tweak.encode()
    return int.from_bytes(b"".join(blake2b(k.to_bytes(8) + said, key=key).digest() for k in range(bits // 512 + 1)))


def luhn(digits: str) -> int:
    """Check digit that follows ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _fill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _card(s: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or not d.strip("0"):
        return None
    n = len(d) - 2
    body = d[0] + str(feistel(int(d[1:-1]), 10 ** n, key, "card", back)).zfill(n)
    return _fill(s, body + str(luhn(body)))


def _ssn(s: str, key: bytes, back: bool) -> str | None:
    a, g, n = int(s[:3]), int(s[4:6]), int(s[7:])
    if a in (0, 666) or a >= 900 or not g or not n:
        return None
    areas = 898                                   # 1-899 without 666
    x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1
    x = feistel(x, areas * 99 * 9999, key, "ssn", back)
    x, n = divmod(x, 9999)
    a, g = divmod(x, 99)
    a += 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{n + 1:04d}"


def _phone(s: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    return _fill(s, d[:-7] + str(feistel(int(d[-7:]), 10 ** 7, key, "phone" + d[-10:-7], back)).zfill(7))


def _ipv4(s: str, key: bytes, back: bool) -> str | None:
    parts = [int(x) for x in s.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in s.split(".")):
        return None
    x = feistel(int.from_bytes(bytes(parts)), 1 << 32, key, "ipv4", back)
    return ".".join(map(str, x.to_bytes(4)))


_FIRST, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _date(s: str, key: bytes, back: bool) -> str | None:
    try:
        x = (date.fromisoformat(s) - _FIRST).days
    except ValueError:
        return None
    return (_FIRST + timedelta(days=feistel(x, _DAYS, key, "date", back))).isoformat()


_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
_CLASS = {c: k for k, x in enumerate(_CLASSES) for c in x}


def _email(s: str, key: bytes, back: bool) -> str | None:
    local, _, host = s.partition("@")
    value, size, bases = 0, 1, []
    for c in local:
        if c in _CLASS:
            base = len(_CLASSES[_CLASS[c]])
            value, size = value * base + _CLASSES[_CLASS[c]].index(c), size * base
            bases.append((_CLASSES[_CLASS[c]]))
    value = feistel(value, size, key, "email@" + host.lower(), back)
    out = []
    for letters in reversed(bases):
        value, k = divmod(value, len(letters))
        out.append(letters[k])
    it = iter(reversed(out))
    return "".join(next(it) if c in _CLASS else c for c in local) + "@" + host


_REPLACE = {"card": _card, "ssn": _ssn, "phone": _phone, "ipv4": _ipv4, "date": _date, "email": _email}


@lru_cache(maxsize=1 << 14)
def pseudonym(kind: str, value: str, key: bytes = KEY, back: bool = False) -> str | None:
    """The value's pseudonym in its own format, ``None`` if the value is not valid.  ``back`` inverts."""
    return _REPLACE[kind](value, key, back)


def _grouped(sizes: list[int]) -> bool:
    """Are these the groups a card is written in?"""
    return len(sizes) == 1 or sizes == [4, 6, 5] or (all(n == 4 for n in sizes[:-1]) and sizes[-1] <= 4)


def _cards(run: str) -> list[tuple[int, int]]:
    """Where cards stand in a run of digit groups: the run itself, or parts of whole groups, leftmost and longest first."""
    if pseudonym("card", run) is not None:
        return [(0, len(run))]
    groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", run)]
    out, i = [], 0
    while i < len(groups):
        best, digits = None, 0
        for j in range(i, min(len(groups), i + 5)):               # five groups are the most a card has
            digits += groups[j][1] - groups[j][0]
            if digits > 19:
                break
            if digits >= 13 and _grouped([e - s for s, e in groups[i:j + 1]]) and pseudonym("card", run[groups[i][0]:groups[j][1]]) is not None:
                best = j
        if best is None:
            i += 1
        else:
            out.append((groups[i][0], groups[best][1]))
            i = best + 1
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """Validated values as (start, end, kind), in order, without overlap."""
    if not _ANY.search(text):
        return []
    taken: list[tuple[int, int, str]] = []
    for kind, pattern in _PATTERNS:
        new = [(m.start() + s, m.start() + e, kind) for m in pattern.finditer(text)
               for s, e in (_cards(m.group()) if kind == "card" else [(0, m.end() - m.start())])
               if pseudonym(kind, m.group()[s:e]) is not None]
        if taken and new:
            both, end, first = sorted(taken), 0, []
            k = 0
            for s, e, x in new:                   # both lists are sorted and free of overlap
                while k < len(both) and both[k][1] <= s:
                    k += 1
                if k == len(both) or both[k][0] >= e:
                    first.append((s, e, x))
            new = first
        taken = sorted(taken + new)
    return taken


def replace(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    spans = find(text)
    out, at = [], 0
    for s, e, kind in spans:
        out += (text[at:s], pseudonym(kind, text[s:e], key, back))
        at = e
    return "".join(out) + text[at:], spans


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``doc_id, text`` with pseudonyms, and the replaced values' ``kind, start, end`` in the input."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def one(b):
        out, spans = [], []
        for t in b.column(1).to_pylist():
            new, found = replace(t, key) if t else (t, [])
            out.append(new)
            spans.append([{"kind": k, "start": s, "end": e} for s, e, k in found])
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(spans, kind)], ["doc_id", "text", "spans"])

    return map_batches(texts(docs), one, "doc_id bigint, text string, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(done: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    joined = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return done.select("doc_id", *[count(k) for k in KINDS], F.size("spans").cast("bigint").alias("n_values"), joined.alias("spans"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
