"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Two lines are linked when their edit distance is at most ``EDITS`` (insertions, deletions and
substitutions of code points); lines of under ``MIN_CHARS`` code points are layout and take no part.
A line is cut into ``EDITS + 1`` segments; of two linked lines one holds a segment of the other
unchanged.  Every line is indexed by its segments (key: length, segment number, content) and probes the keys
of equal or up to ``EDITS`` shorter lines with the substrings whose place leaves enough edits for
both sides (length-aware, multi-match selection).  Candidates, cut to what lies
between their common ends, are verified with a banded bit-parallel edit distance: one word of ``2 * EDITS + 1`` bits slides down the diagonal.

Only a line's first occurrence makes keys, so a frequent line is one row per key; joins are plain
equi-joins that Spark may split where a key is frequent.  Lines of a frequent key do not meet in pairs: what
the key leaves of them, without the ends they all share, is cut into segments again, until
the keys are rare; no link is lost by it.  Lists of line hashes (the lines that repeat, the
candidates) are broadcast up to ``BROADCAST_ROWS`` counted rows, so the texts need not be shuffled
to meet them, and joined by shuffle beyond.

A line goes when it occurs earlier (by ``doc_id``, then place), or a line linked to it first occurs
earlier; both are judged on the input, not on what is left.

Defined results: null text stays null and has no lines; the empty text is one empty line; rows with
equal ``doc_id`` and text are one document and all get its result; of rows with an equal ``doc_id``
and different texts the order is that of the texts' hashes; a null ``doc_id`` comes before all others;
extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

EDITS = 2
MIN_CHARS = 20
BROADCAST_ROWS = 1_000_000
GROUP = 16                                   # indexed lines of a key that still meet in pairs
_WORD = 60                                   # lines per word of a document's keep mask


def _text_key() -> Column:
    """Tells rows of one ``doc_id`` apart by their text."""
    text = F.col("text").cast("string")
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("rk", _text_key())


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, rk, line_no, line, n, h, g`` of every line that takes part: ``n`` its length, ``h, g`` its hash."""
    parts = _source(docs).select("doc_id", "rk", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return (parts.withColumn("n", F.char_length("line")).where(F.col("n") >= MIN_CHARS)
            .withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(1), "line")))


def _rows(docs: DataFrame) -> DataFrame:
    """:func:`lines_of`, written once: every later step reads the columns it needs instead of cutting the texts again."""
    return staged(lines_of(docs), "line-rows")


def _placed(lines: DataFrame, places: list[tuple[int, int, int]]) -> DataFrame:
    """A row for every place (``less``, ``i``, ``shift``): segment ``i`` (from 0) of a line ``less`` shorter
    (``m`` long), of which the content stands ``shift`` further right in this line (``at``, ``size``)."""
    k = EDITS + 1
    spec = F.array(*[F.struct(F.lit(x).alias("less"), F.lit(i).alias("i"), F.lit(y).alias("shift")) for x, i, y in places])
    rows = lines.select("h", "n", "line", F.explode(spec).alias("s")).select("h", "n", "line", "s.*", (F.col("n") - F.col("s.less")).alias("m"))
    rows = rows.select("*", *_segment(F.col("m"), F.col("i"), k))
    rows = rows.select("h", "n", "line", "less", "i", "shift", "m", (F.col("o") + F.col("shift") + 1).alias("at"), "size")
    return rows.where((F.col("at") >= 1) & (F.col("at") + F.col("size") - 1 <= F.col("n")))


def _segment(m: Column, i: Column, k: int) -> tuple[Column, Column]:
    """Offset ``o`` and ``size`` of segment ``i`` of ``k`` in ``m`` characters; ``m % k`` of the last have one more."""
    base = F.call_function("div", m, F.lit(k)).cast("int")
    over = i - (k - m % k)
    return (base * i + F.greatest(F.lit(0), over)).alias("o"), (base + (over >= 0).cast("int")).alias("size")


def _place_key() -> Column:
    return F.xxhash64("i", "m", F.substring(F.col("line"), F.col("at"), F.col("size"))).alias("key")


def _keyed(lines: DataFrame, places: list[tuple[int, int, int]]) -> DataFrame:
    """``h, key`` for every place.  The places are multiplied first and one key is worked out a row: as one array of a key
    for every place the code of a line is too long for the JVM to compile.  The line is not shuffled."""
    return _placed(lines, places).select("h", _place_key())


_INDEX = [(0, i, 0) for i in range(EDITS + 1)]
_PROBE = [(less, i, shift) for less in range(EDITS + 1) for i in range(EDITS + 1)
          for shift in range(max(-i, less - (EDITS - i)), min(i, less + (EDITS - i)) + 1)]


def segment_keys(lines: DataFrame) -> DataFrame:
    """Index keys of every line."""
    return _keyed(lines, _INDEX)


def probe_keys(lines: DataFrame) -> DataFrame:
    """Keys of the lines up to ``EDITS`` shorter that may be linked to a line."""
    return _keyed(lines, _PROBE)


def within_edits(a: Column, b: Column, ca: Column, cb: Column) -> Column:
    """Is the edit distance of two strings at most ``EDITS``?  Banded bit-parallel (bit b of a
    column's word is the row b - EDITS off the diagonal).  ``ca`` and ``cb`` are columns that hold the
    strings' characters, so that no step cuts them up again."""
    e, full = EDITS, (1 << (2 * EDITS + 1)) - 1
    n, m = F.size(ca), F.size(cb)                    # rows: a; columns: b

    def match(j):                                    # column j (from 1): which rows of the band hold its character
        c = F.get(cb, j - 1)
        bits = [F.when(F.get(ca, j - 1 - e + k) == c, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
                for k in range(2 * e + 1)]
        word = bits[0]
        for x in bits[1:]:
            word = word.bitwiseOR(x)
        return F.struct(j.alias("j"), word.alias("m"))

    cols = F.transform(F.sequence(F.lit(1), m), match)
    zero, one, inv = F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), F.lit(full).cast("bigint")
    start = F.struct(F.lit(full & ~((1 << e) - 1)).cast("bigint").alias("vp"), zero.alias("vn"), F.lit(e).cast("bigint").alias("d"))

    def step(s, x):
        vp, vn, w = s["vp"], s["vn"], x["m"]
        d0 = ((w.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(w).bitwiseOR(vn).bitwiseAND(inv)
        hp = vn.bitwiseOR(d0.bitwiseOR(vp).bitwiseXOR(inv))
        hn = d0.bitwiseAND(vp)
        half = F.shiftright(d0, 1)
        bit = n - x["j"] + e                         # the last row's bit once the band has reached it
        at = lambda v: F.call_function("shiftright", v, bit).bitwiseAND(one)
        d = F.when(bit >= 2 * e, s["d"] + one - F.shiftright(d0, 2 * e).bitwiseAND(one)).otherwise(s["d"] + at(hp) - at(hn))
        return F.struct(hn.bitwiseOR(half.bitwiseOR(hp).bitwiseXOR(inv)).alias("vp"), half.bitwiseAND(hp).alias("vn"), d.alias("d"))

    dist = F.aggregate(cols, start, step, lambda s: s["d"])
    short = F.least(F.char_length(a), F.char_length(b)) <= 2 * e     # the band has no room to slide
    return F.when(short, F.levenshtein(a, b) <= e).otherwise((F.abs(n - m) <= e) & (dist <= e))


def _common(a: Column, b: Column) -> Column:
    """Length of a common beginning of two strings, by halving steps from a power of two over the shorter one's length."""
    most = F.least(F.char_length(a), F.char_length(b))
    top = F.least(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int") + 1, F.lit(30))       # 1 more than needed: a logarithm is rounded
    steps = F.transform(F.sequence(F.lit(0), top), lambda k: F.call_function("shiftleft", F.lit(1), top - k))
    same = lambda n, s: F.substring(a, n + 1, s) == F.substring(b, n + 1, s)
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= most) & same(n, s), n + s).otherwise(n))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once (a projection below would be computed at each use)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _between_ends(x: Column, y: Column, then: Callable[[Column, Column], Column]) -> Column:
    """``then`` of what is left of two strings without their common beginning and end, both reversed."""
    rest = lambda s, k: F.substring(s, k + 1, F.char_length(s))
    head = lambda k: F.struct(F.reverse(rest(x, k)).alias("x"), F.reverse(rest(y, k)).alias("y"))
    tail = lambda p: _let(_common(p["x"], p["y"]), lambda k: F.struct(rest(p["x"], k).alias("x"), rest(p["y"], k).alias("y")))
    return _let(_let(_let(_common(x, y), head), tail), lambda p: then(p["x"], p["y"]))


def close(pairs: DataFrame) -> DataFrame:
    """The rows ``a, b, x, y`` whose lines ``x``, ``y`` are within ``EDITS``; only what lies between their common
    ends is compared.  What is left differs in its first and in its last character, which takes both of
    two edits: all that stands between must be in the other unchanged, or the pair is not verified."""
    assert EDITS == 2

    def verdict(x, y):
        inner = F.substring(x, F.lit(2), F.greatest(F.char_length(x) - 2, F.lit(0)))
        cut = F.struct(F.split(x, "").alias("x"), F.split(y, "").alias("y"))
        return F.when(F.contains(y, inner), _let(cut, lambda c: within_edits(x, y, c["x"], c["y"]))).otherwise(False)

    return pairs.where(_between_ends(F.col("x"), F.col("y"), verdict)).select("a", "b")


def _sized(df: DataFrame) -> DataFrame:
    """A written list of hashes, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def first_places(lines: DataFrame) -> DataFrame:
    """``h, g, first, times`` of every distinct line, written once."""
    return staged(lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "rk", "line_no")).alias("first"), F.count("*").alias("times")), "line-first")


def once(lines: DataFrame, first: DataFrame) -> DataFrame:
    """First occurrences only: ``h, n, line``."""
    often = staged(first.where("times > 1").select("h", "g", "first"), "line-often")
    return (lines.join(_sized(often), ["h", "g"], "left")
            .where(F.col("first").isNull() | F.struct("doc_id", "rk", "line_no").eqNullSafe(F.col("first")))
            .select("h", "n", "line"))


def _opened(lines: DataFrame) -> DataFrame:
    """The probe places with their key and what is still to be compared: ``b`` = 2, one piece within two edits, or
    ``b`` = 1, two pieces within one edit each.  A piece: start, length, and how much longer it is than the
    indexed line's (0 there).  Of two linked lines some segment ``i`` is unchanged with at most ``i`` edits before
    it and ``EDITS - i`` behind it, so the first and the last leave one piece, the middle one two.
    ``u``, ``v``: length of the first segment in the piece ``p``, ``q``, if the key is that of a later one.
    ``own``: the place is one the line is indexed by, too."""
    assert EDITS == 2
    left = F.struct(F.lit(1).alias("s"), (F.col("at") - 1).alias("n"), F.col("shift").alias("d"))
    end = F.col("at") + F.col("size")
    right = F.struct(end.alias("s"), (F.col("n") - end + 1).alias("n"), (F.col("less") - F.col("shift")).alias("d"))
    none = F.struct(F.lit(1).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("d"))
    return _placed(lines, _PROBE).select(
        _place_key(), ((F.col("less") == 0) & (F.col("shift") == 0)).alias("own"), "h", "line", F.when(F.col("i") == 1, 1).otherwise(2).alias("b"),
        F.when(F.col("i") == 0, right).otherwise(left).alias("p"), F.when(F.col("i") == 1, right).otherwise(none).alias("q"),
        F.when(F.col("i") > 0, F.floor(F.col("m") / 3).cast("int")).alias("u"), F.lit(None).cast("int").alias("v"))


def _stripped(rows: DataFrame) -> DataFrame:
    """Every piece without the beginning and the end that all of its key's rows have in common (that of the
    smallest and the largest): equal ends change no distance.  Keys of a later segment whose rows all share the first
    one as well go: their pairs meet by the key of the first."""
    piece = {x: F.substring(F.col("line"), F.col(f"{x}.s"), F.col(f"{x}.n")) for x in "pq"}
    aggs = [f(g(piece[x])).alias(f"{x}_{a}{c}") for x in "pq" for a, f in (("min", F.min), ("max", F.max))
            for c, g in (("", lambda v: v), ("r", F.reverse))]
    ends = rows.groupBy("key").agg(*aggs, *[F.min(f"{x}.n").alias(f"{x}_n") for x in "pq"], F.min("u").alias("u"), F.min("v").alias("v"))
    ends = ends.select("key", "u", "v", *[c for x in "pq" for c in (
        F.col(f"{x}_n"), _common(F.col(f"{x}_min"), F.col(f"{x}_max")).alias(f"{x}_head"),
        _common(F.col(f"{x}_minr"), F.col(f"{x}_maxr")).alias(f"{x}_tail"))])
    ends = ends.where(~F.coalesce(F.col("p_head") >= F.col("u"), F.lit(False)) & ~F.coalesce(F.col("q_head") >= F.col("v"), F.lit(False)))
    ends = staged(ends.select("key", *[c for x in "pq" for c in (
        F.col(f"{x}_head"), F.least(f"{x}_tail", F.col(f"{x}_n") - F.col(f"{x}_head")).alias(f"{x}_tail"))]), "line-ends")
    cut = lambda x: F.struct((F.col(f"{x}.s") + F.col(f"{x}_head")).alias("s"),
                             (F.col(f"{x}.n") - F.col(f"{x}_head") - F.col(f"{x}_tail")).alias("n"), F.col(f"{x}.d").alias("d"))
    return rows.join(_sized(ends), "key").select("key", "own", "h", "line", "b", cut("p").alias("p"), cut("q").alias("q"))


def _refined(rows: DataFrame) -> DataFrame:
    """The rows one step further: the pieces are cut into segments again, of which one is unchanged; it joins the
    key, and what lies beside it stays to be compared.  ``done``: what stays is too short to be cut."""
    opt = lambda i, j, t: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.lit(t) if isinstance(t, int) else t).alias("t"))
    part = lambda s, n: F.substring(F.col("line"), s, n)
    struct = lambda s, n, d: F.struct(s.cast("int").alias("s"), n.cast("int").alias("n"), d.cast("int").alias("d"))
    m = F.col("p.n") - F.col("p.d")

    def inside(x):                                   # the place lies in the piece and leaves edits enough for both sides
        o, size = _segment(m, x["i"], 3)
        return (o + x["t"] >= 0) & (o + x["t"] + size <= F.col("p.n")) & ((x["i"] != 1) | (F.abs(F.col("p.d") - x["t"]) <= 1))

    two = F.filter(F.array(opt(0, 0, 0), *[opt(1, 0, t) for t in (-1, 0, 1)], opt(2, 0, F.col("p.d"))), inside)
    a = rows.where("b = 2").select("*", F.explode(two).alias("x")).select("*", "x.i", "x.t")
    a = a.select("*", *_segment(m, F.col("i"), 3)).withColumn("o", F.col("o") + F.col("t"))
    left = struct(F.col("p.s"), F.col("o"), F.col("t"))
    right = struct(F.col("p.s") + F.col("o") + F.col("size"), F.col("p.n") - F.col("o") - F.col("size"), F.col("p.d") - F.col("t"))
    none = struct(F.lit(1), F.lit(0), F.lit(0))
    a = a.select(F.xxhash64("key", "i", part(F.col("p.s") + F.col("o"), F.col("size"))).alias("key"), (F.col("own") & (F.col("t") == 0)).alias("own"), "h", "line",
                 F.when(F.col("i") == 1, 1).otherwise(2).alias("b"),
                 F.when(F.col("i") == 0, right).otherwise(left).alias("p"), F.when(F.col("i") == 1, right).otherwise(none).alias("q"),
                 F.when(F.col("i") > 0, F.floor(m / 3).cast("int")).alias("u"), F.lit(None).cast("int").alias("v"))

    half = lambda x: F.floor((F.col(f"{x}.n") - F.col(f"{x}.d")) / 2).cast("int")
    c = rows.where("b = 1").select("*", half("p").alias("p0"), half("q").alias("q0"))
    fits = lambda x, i: F.when(i == 0, F.col(f"{x}0") <= F.col(f"{x}.n")).otherwise(F.col(f"{x}0") + F.col(f"{x}.d") >= 0)
    one = F.filter(F.array(*[opt(i, j, 0) for i in (0, 1) for j in (0, 1)]), lambda x: fits("p", x["i"]) & fits("q", x["j"]))
    c = c.select("*", F.explode(one).alias("x")).select("*", "x.i", "x.j")
    same = lambda x, i: F.when(F.col(i) == 0, part(F.col(f"{x}.s"), F.col(f"{x}0"))).otherwise(
        part(F.col(f"{x}.s") + F.col(f"{x}0") + F.col(f"{x}.d"), F.col(f"{x}.n") - F.col(f"{x}.d") - F.col(f"{x}0")))
    rest = lambda x, i: F.when(F.col(i) == 0, struct(F.col(f"{x}.s") + F.col(f"{x}0"), F.col(f"{x}.n") - F.col(f"{x}0"), F.col(f"{x}.d"))).otherwise(
        struct(F.col(f"{x}.s"), F.col(f"{x}0") + F.col(f"{x}.d"), F.col(f"{x}.d")))
    c = c.select(F.xxhash64("key", "i", "j", same("p", "i"), same("q", "j")).alias("key"), "own", "h", "line", "b",
                 rest("p", "i").alias("p"), rest("q", "j").alias("q"),
                 F.when(F.col("i") == 1, F.col("p0")).alias("u"), F.when(F.col("j") == 1, F.col("q0")).alias("v"))
    short = lambda x, n: F.col(f"{x}.n") - F.col(f"{x}.d") < n
    return a.unionByName(c).withColumn("done", F.when(F.col("b") == 2, short("p", 3)).otherwise(short("p", 2) & short("q", 2)))


def _pair() -> list[Column]:
    return [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]


def candidates(lines: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of line hashes that share a key, a before b, each once.

    A key of more than ``GROUP`` indexed lines makes no pairs; its lines are keyed again by segments
    of what the key leaves, until a key's lines are few or differ in two characters at most."""
    index, probe = staged(segment_keys(lines), "line-index"), probe_keys(lines)       # the index is read twice
    hot = staged(index.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > GROUP).select("key"), "line-hot")
    few = index.join(_sized(hot), "key", "left_anti").select("key", F.col("h").alias("a"))
    marked = few.unionByName(hot.select("key", F.lit(None).cast("bigint").alias("a")))
    met = probe.withColumnRenamed("h", "b").join(marked, "key").where(F.col("a").isNull() | (F.col("a") != F.col("b")))
    met = staged(met.select(F.when(F.col("a").isNotNull(), F.least("a", "b")).alias("a"),
                            F.when(F.col("a").isNull(), F.col("b")).otherwise(F.greatest("a", "b")).alias("b")).distinct(), "line-met-keys")
    found = met.where("a is not null")
    if hot.isEmpty():
        return found
    own = lines.join(_sized(met.where("a is null").select(F.col("b").alias("h"))), "h", "left_semi")
    own = staged(own.dropDuplicates(["h"]), "line-hot-lines")
    rows = _opened(own).join(_sized(hot), "key", "left_semi")
    while not hot.isEmpty():
        kids = staged(_refined(_stripped(staged(rows, "line-hot-rows"))), "line-refined")
        hot = kids.where("own").groupBy("key", "done").agg(F.count("*").alias("c"))
        hot = staged(hot.where(~F.col("done") & (F.col("c") > GROUP)).select("key"), "line-hot")
        few = kids.where("own").join(_sized(hot), "key", "left_anti").select("key", F.col("h").alias("a"))
        pairs = kids.select("key", F.col("h").alias("b")).join(few, "key").where("a != b").select(*_pair()).distinct()
        found = found.unionByName(staged(pairs, "line-pairs"))
        rows = kids.drop("done").join(_sized(hot), "key", "left_semi")
    return found.distinct()


def line_links(lines: DataFrame) -> DataFrame:
    """Verified links ``a, b`` (line hashes, a < b) between different lines (each given once)."""
    cand = staged(candidates(lines), "line-candidates")
    ids = staged(cand.select(F.col("a").alias("h")).unionByName(cand.select(F.col("b").alias("h"))).distinct(), "line-ids")
    text = lines.join(_sized(ids), "h", "left_semi")
    text = staged(text.select("h", "line").dropDuplicates(["h"]), "line-texts")
    pairs = (cand.join(text.select(F.col("h").alias("a"), F.col("line").alias("x")), "a")
             .join(text.select(F.col("h").alias("b"), F.col("line").alias("y")), "b"))
    return close(pairs)


def _judged(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct lines with first place and verdict (``h, g, first, kept``), and links per line."""
    first = first_places(lines)
    links = staged(line_links(once(lines, first)), "line-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = (both.join(first.select(F.col("h").alias("b"), F.col("first").alias("other")), "b")
           .groupBy("a").agg(F.min("other").alias("other"), F.count("*").alias("links")).withColumnRenamed("a", "h"))
    met = staged(met, "line-met")
    judged = first.join(met, "h", "left").select("h", "g", "first", (F.col("other").isNull() | (F.col("first") < F.col("other"))).alias("kept"))
    return judged, met.select("h", "links")


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``, and ``n_lines``, ``n_removed``."""
    judged, _ = _judged(_rows(docs))
    return _apply(docs, judged)


def _apply(docs: DataFrame, judged: DataFrame) -> DataFrame:
    own = docs.withColumn("__id", F.col("doc_id").cast("bigint")).withColumn("__rk", _text_key())
    kept = judged.where("kept").select("first.*").select(
        "doc_id", "rk", F.floor(F.col("line_no") / _WORD).cast("int").alias("word"),
        F.expr(f"shiftleft(1L, line_no % {_WORD})").alias("bits"))
    blank = _source(docs).where("text is not null").select("doc_id", "rk", F.explode(F.sequence(
        F.lit(0), F.floor((F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))) / _WORD).cast("int"))).alias("word"), F.lit(0).cast("bigint").alias("bits"))
    mask = (kept.unionByName(blank).groupBy("doc_id", "rk", "word").agg(F.bit_or("bits").alias("bits"))
            .groupBy("doc_id", "rk").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("mask"))
            .select(F.col("doc_id").alias("__mid"), F.col("rk").alias("__mrk"), F.col("mask.bits").alias("__mask")))
    lines = F.split(F.col("text").cast("string"), "\n")
    bit = lambda i: F.get(F.col("__mask"), F.floor(i / _WORD).cast("int"))
    stays = F.filter(lines, lambda x, i: (F.char_length(x) < MIN_CHARS) |
                     (F.call_function("shiftright", bit(i), (i % _WORD)).bitwiseAND(F.lit(1).cast("bigint")) == 1))
    out = (own.join(mask, (F.col("__rk") == F.col("__mrk")) & F.col("__id").eqNullSafe(F.col("__mid")), "left")
           .withColumn("__stays", stays).withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("bigint"))
           .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("bigint"))
           .withColumn("n_removed", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines") - F.size("__stays")).cast("bigint"))
           .withColumn("text", F.when(F.col("text").isNotNull(), F.array_join("__stays", "\n"))))
    return out.drop("__id", "__rk", "__mid", "__mrk", "__mask", "__stays")


def report(docs: DataFrame) -> DataFrame:
    """Per document: lines, removed lines, links of its lines to different lines, hash of what is left."""
    lines = _rows(docs)
    judged, met = _judged(lines)
    done = _apply(docs.select("doc_id", "text").withColumn("__rk0", _text_key()), judged).select(
        "doc_id", "__rk0", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
    per = (lines.select("doc_id", "rk", "line_no", "h").join(_sized(met), "h").distinct()
           .groupBy(F.col("doc_id").alias("__i"), F.col("rk").alias("__r")).agg(F.sum("links").alias("n_links")))
    return (done.join(per, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__i")) & (F.col("__rk0") == F.col("__r")), "left")
            .select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_lines", "n_removed",
                    F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "kept_sha256"))
