"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its lower-cased words.  The texts are cut into words once; from there on a word is its 64-bit
hash, and sets are compared by these.  Equal sets are met first, by a hash of the set.  The different sets are joined by
prefix filtering: words are ordered by rarity (a table of counts by hash bucket), a set of n words publishes its
``n - ceil(8n/9) + 1`` rarest as the shorter side and looks up its ``n - ceil(4n/5) + 1`` rarest as the longer one,
and pairs that share such a word pass a length filter, a positional filter and a signature of their rare words before their Jaccard
similarity (0.8 or more) is verified on the whole sets.  Of a matching pair the later line is removed.

One earlier match is enough to remove a line.  So where many sets share two words at the ends of their prefixes they are first
compared with a few early ones alone, which settles the copies of a line at a cost that grows with their number, not with
its square; then pairs are formed only where the later side is not settled.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import small_side
from .common import SPACE_CLASS, materialize, remove

#: Buckets of the table of word counts, words of the bit filter of candidate sets, and words at either end of a prefix by which copies meet first.
COUNTS, BITS, LEAD = 1 << 16, 1 << 16, 2
#: Lines that share two words at the ends of their prefixes, beyond which they are first compared with a few early ones.
CROWD = 64
#: Sets of each group, the earliest of as many parts of it, that all others are compared with first.
HEADS = 8
#: Parts, a power of two, in which the sets' prefixes are shuffled one after the other: so much less disk at a time.
PASSES = 4
#: Level of a word that one line has.
ALONE = 5
#: Shares of all words in lines that the two signatures reach up to.
RARE = (0.25, 0.67)
#: What the filters of a pair read of either side, beside its size.
SIGNED = ("r0", "r1")
#: Signature of all words of a set.
WIDE = ("s0", "s1", "s2", "s3")
#: Orders a null id before all others.
NO_ID = -(1 << 63)


def _bit(place: Column) -> Column:
    """A long with the bit at ``place`` modulo 64 set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def _quarter(k: int):
    """Folds hashes into the kth of four words of a 256-bit signature."""
    return lambda a, x: F.when(F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(3)) == k, a.bitwiseOR(_bit(x))).otherwise(a)


def text_key(text_col: str) -> Column:
    """Tells apart documents that share an id, or have none, by their text."""
    return F.xxhash64(F.col(text_col).cast("string"))


def tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, tid, line_no, sid, n, h`` of every line with a word: its set's hash and size, and its words' hashes in order.

    The explode of one value binds it to a name, so it is worked out once.
    """
    low = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("tid"), F.explode(F.array(F.lower(F.col(text_col).cast("string")))).alias("low"))
    other = [F.col("low").contains(c) for c in "\t\x0b\x0c\r"]
    plain = F.when(reduce(Column.__or__, other), F.regexp_replace("low", r"[\x09\x0B-\x0D]", " ")).otherwise(F.col("low"))
    lines = low.select("doc_id", "tid", F.posexplode(F.split(plain, "\n")).alias("line_no", "line"))
    hashes = F.sort_array(F.array_except(F.transform(F.split("line", " "), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit("")))))
    words = lines.select("doc_id", "tid", "line_no", F.explode(F.array(hashes)).alias("h")).where(F.size("h") > 0)
    return words.select("doc_id", "tid", "line_no", F.xxhash64("h").alias("sid"), F.size("h").alias("n"), "h")


def _dense(df: DataFrame, size: int, key: str, value: str) -> Column:
    """An array of ``size`` numbers with ``value`` at place ``key`` and 0 elsewhere, as a scalar subquery."""
    zero = df.sparkSession.range(size).select(F.col("id").alias(key), F.lit(0).cast("long").alias(value))
    filled = df.select(F.col(key).cast("long").alias(key), F.col(value).cast("long").alias(value)).union(zero).groupBy(key).agg(F.sum(value).alias(value))
    return filled.agg(F.array_sort(F.collect_list(F.struct(key, value)))[value].alias("x")).scalar()


def rarity(words: DataFrame) -> bytes:
    """Levels (four a doubling, 1 to 127) of the numbers of lines with a word, by hash bucket, a byte each."""
    counts = words.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(F.lit(COUNTS - 1)).alias("b")).agg(F.count("*").alias("c"))
    level = F.least(F.lit(127), 1 + F.round(4 * F.log2(F.col("c") + 1))).cast("int")
    dense = counts.select("b", level.alias("v")).union(words.sparkSession.range(COUNTS).select(F.col("id").alias("b"), F.lit(1).alias("v"))).groupBy("b").agg(F.max("v").alias("v"))
    # COUNTS bytes; a subquery cannot stand in a lambda, so the table goes into the plan as a constant array.
    return dense.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "v")))["v"], lambda v: F.char(v)), "")).first()[0].encode("ascii")


def _level(levels: bytes, h: Column) -> Column:
    """The level of a word's bucket; the optimizer folds the text of the table into an array."""
    return F.get(F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>"), h.bitwiseAND(F.lit(COUNTS - 1)).cast("int"))


@contextmanager
def short_plans(spark: SparkSession, length: int = 20_000):
    """While a plan holds the table of levels as a constant, the driver keeps the beginning of its text alone.

    Spark stores the text of every plan, and of each change to it at run time, with all numbers of the table.
    """
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(length))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def level_of_share(levels: bytes, share: float) -> int:
    """The level up to which this share of all words in lines lies."""
    number = np.bincount(np.frombuffer(levels, dtype=np.uint8), minlength=128)
    uses = np.cumsum(number * 2.0 ** (np.arange(128) / 4))
    return int(np.searchsorted(uses, uses[-1] * share))


def signed(words: DataFrame, levels: bytes) -> DataFrame:
    """``sid, n, first, pre, r0, r1`` of every line: its set's hash, size and place, its prefix, and a signature.

    ``pre`` holds a number for each of the rarest words, 0 where no other line has the word.  ``r0`` and ``r1`` are
    signatures of 64 bits of the words that are rare anywhere and of those less rare (a quarter of all uses, and up to
    two thirds); frequent words, which unlike lines share, are left out.
    """
    keys = F.sort_array(F.transform("h", lambda h: F.shiftleft(_level(levels, h), 54).bitwiseOR(h.bitwiseAND(F.lit((1 << 54) - 1)))))
    keyed = words.select("sid", "n", F.struct("doc_id", "tid", "line_no").alias("first"), F.explode(F.array(keys)).alias("k"))
    limits = [(level_of_share(levels, share) + 1) << 54 for share in RARE]
    bits = lambda low, high: F.aggregate(F.filter("k", lambda k: (k >= low) & (k < high)), F.lit(0).cast("long"), lambda a, k: a.bitwiseOR(_bit(k)))
    pre = F.slice("k", 1, F.col("n") - F.floor((4 * F.col("n") + 4) / 5).cast("int") + 1)
    number = F.transform(pre, lambda k: F.when(F.shiftrightunsigned(k, 54) <= ALONE, 0).otherwise(F.hash(k).bitwiseOR(F.lit(1))))
    return keyed.select("sid", "n", "first", number.alias("pre"), bits(0, limits[0]).alias("r0"), bits(*limits).alias("r1"))


def _filters(x: str, y: str, first: bool) -> Column:
    """Length, positional and signature filter for a shorter side x and a longer side y.

    Sets of Jaccard 0.8 differ in ``(n + m) / 9`` words at most, and in no more bits of a signature.  With ``first`` the
    pair passes at the first word that both have, where all words in common are still to come, and at few others.
    """
    n, m, i, j = F.abs(f"{x}.n"), F.abs(f"{y}.n"), F.col(f"{x}.i"), F.col(f"{y}.i")
    need = F.floor((4 * (n + m) + 8) / 9)
    differ = F.bit_count(F.col(f"{x}.r0").bitwiseXOR(F.col(f"{y}.r0"))) + F.bit_count(F.col(f"{x}.r1").bitwiseXOR(F.col(f"{y}.r1")))
    before = F.lit(0) if first else F.least(i, j)
    return (5 * n >= 4 * m) & (before + F.least(n - i, m - j) >= need) & (differ <= n + m - 2 * need)


def whole_sets(sids: DataFrame, sets: DataFrame, words: DataFrame) -> DataFrame:
    """``sid, first, h, n`` and a signature of 256 bits of all words (``WIDE``) of the sets named, a written table.

    Only lines whose set passes a bit filter travel.
    """
    ids = materialize(sids.distinct().join(sets.select("sid", "first"), "sid"), "line-ids")
    slot = F.col("sid").bitwiseAND(F.lit(BITS * 64 - 1))
    marks = ids.select(slot.alias("s")).distinct().groupBy(F.shiftright("s", 6).alias("k")).agg(F.bit_or(_bit(F.col("s"))).alias("v"))
    bits = _dense(marks, BITS, "k", "v")
    near = words.where(F.call_function("shiftrightunsigned", F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    at = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("tid") == F.col("first.tid")) & (F.col("line_no") == F.col("first.line_no"))
    found = near.join(ids, "sid").where(at).dropDuplicates(["sid"])
    bits256 = [F.aggregate("h", F.lit(0).cast("long"), _quarter(k)).alias(c) for k, c in enumerate(WIDE)]
    whole = materialize(found.select("sid", "first", "h", "n", *bits256), "line-words")
    remove(ids)
    return whole


def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Set ids whose line matches an earlier one, of candidate ``pairs(a, b)``: Jaccard on the whole sets.

    The signatures thin the pairs before any set travels.
    """
    side = lambda p, *c: whole.select(*[F.col(x).alias(f"{p}_{x}") for x in ("sid", *c)])
    narrow = pairs.join(side("x", "n", *WIDE), F.col("a") == F.col("x_sid")).join(side("y", "n", *WIDE), F.col("b") == F.col("y_sid"))
    apart = sum((F.bit_count(F.col(f"x_s{k}").bitwiseAND(F.bitwise_not(F.col(f"y_s{k}")))) for k in range(1, 4)), F.bit_count(F.col("x_s0").bitwiseAND(F.bitwise_not(F.col("y_s0")))))
    alike = narrow.where(F.col("x_n") - apart >= F.floor((4 * (F.col("x_n") + F.col("y_n")) + 8) / 9)).select("a", "b")
    both = alike.join(side("x", "first", "h", "n"), F.col("a") == F.col("x_sid")).join(side("y", "first", "h", "n"), F.col("b") == F.col("y_sid"))
    shared = F.size(F.array_intersect("x_h", "y_h"))
    match = 5 * shared >= 4 * (F.col("x_n") + F.col("y_n") - shared)
    return materialize(both.where(match).select(F.when(F.col("x_first") > F.col("y_first"), F.col("a")).otherwise(F.col("b")).alias("sid")).distinct(), "line-later")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tid, line_no`` of the lines that match an earlier line, a written table.

    Earlier is the smaller (doc_id, hash of the text, line number); a null id comes first.
    """
    text = docs.select(F.col(id_col), F.col(text_col))
    words = materialize(tokens(text, id_col, text_col), "line-tokens", compression="zstd", **{"parquet.dictionary.page.size": str(16 << 20)})
    sets = signed(words, rarity(words)).groupBy("sid").agg(F.min("first").alias("first"), *[F.first(c).alias(c) for c in ("n", *SIGNED, "pre")])
    with short_plans(docs.sparkSession):
        sets = materialize(sets, "line-sets")
    doc = F.coalesce("first.doc_id", F.lit(NO_ID)).alias("doc")
    able = sets.where("n >= 4")

    # The rarest words tell few copies from other lines; words of very many copies are the least rare of a prefix.  Two of them
    # together are shared by copies, while one word alone is in more and more lines that have nothing else in common.
    ends = F.filter(F.transform("pre", lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: (x["t"] != 0) & ((x["i"] < LEAD) | (x["i"] >= F.size("pre") - LEAD)))
    two = F.flatten(F.transform("ends", lambda a: F.transform(F.filter("ends", lambda b: b["i"] > a["i"]), lambda b: F.struct(a["i"].alias("i"), F.hash(a["t"], b["t"]).alias("t")))))
    lead = able.select("sid", "n", *SIGNED, doc, F.explode(F.array(ends)).alias("ends")).select("sid", "n", *SIGNED, "doc", F.explode(two).alias("x")).select("sid", "n", *SIGNED, "doc", "x.i", "x.t")
    crowds = lead.groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") > CROWD).select(F.col("t").alias("u"))
    crowds = materialize(crowds, "line-crowds")
    lead = materialize(lead.join(crowds, F.col("t") == F.col("u"), "left_semi"), "line-lead")
    one = F.struct("doc", "sid", "n", *SIGNED, "i")
    heads = lead.groupBy("t").agg(F.array_compact(F.array(*[F.min(F.when(F.pmod("sid", F.lit(HEADS)) == k, one)) for k in range(HEADS)])).alias("heads"))
    tried = lead.alias("y").join(heads.select(F.col("t").alias("u"), "heads"), F.col("t") == F.col("u")).select(F.struct("y.*").alias("y"), F.explode("heads").alias("x"))
    wider = F.when(F.col("x.n") <= F.col("y.n"), _filters("x", "y", False)).otherwise(_filters("y", "x", False))
    early = tried.where((F.col("x.sid") != F.col("y.sid")) & (F.col("x.doc") <= F.col("y.doc")) & wider)
    early = materialize(early.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct(), "line-pairs")
    whole = whole_sets(lead.select("sid"), sets, words)
    remove(crowds, lead)
    settled = verified(early, whole)
    known = materialize(whole.select("sid", *WIDE).join(settled.withColumn("done", F.lit(True)), "sid", "left"), "line-known")
    remove(whole, early)

    flagged = able.join(small_side(known), "sid", "left").select("sid", F.when(F.col("done"), -F.col("n")).otherwise(F.col("n")).alias("n"), *SIGNED, *WIDE, doc, "pre")
    # Both sides read one exchange: that the shorter side publishes fewer words is asked of the pair, not of the side.
    entries = flagged.select("sid", "n", *SIGNED, *WIDE, "doc", F.posexplode("pre").alias("i", "t")).where("t <> 0")
    published = F.col("x.i") < F.abs("x.n") - F.floor((8 * F.abs("x.n") + 8) / 9).cast("int") + F.when(F.col("y.i") >= 0, 1).otherwise(0)
    once = (F.abs("x.n") < F.abs("y.n")) | (F.abs("x.n") == F.abs("y.n")) & (F.col("x.sid") < F.col("y.sid"))
    # Which of two lines of one document is the later one is not known here: either may be.
    open_ = ((F.col("x.n") > 0) & (F.col("x.doc") >= F.col("y.doc"))) | ((F.col("y.n") > 0) & (F.col("y.doc") >= F.col("x.doc")))
    # Lines of a crowd that are not settled are unlike its early ones, but not much: these have wider signatures.
    bits = F.abs("x.n") + F.abs("y.n") - 2 * F.floor((4 * (F.abs("x.n") + F.abs("y.n")) + 8) / 9)
    close = F.coalesce(reduce(Column.__add__, [F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in WIDE]) <= bits, F.lit(True))
    parts = []
    for k in range(PASSES):  # by the word, so every pass finds all pairs that share one of its words
        some = entries.where(F.shiftright("t", 1).bitwiseAND(F.lit(PASSES - 1)) == k)
        met = some.alias("x").join(some.alias("y"), (F.col("x.t") == F.col("y.t")) & once & published & open_ & _filters("x", "y", True) & close)
        parts.append(materialize(met.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct(), "line-pairs"))
    pairs = materialize(reduce(DataFrame.union, parts).distinct(), "line-pairs")
    remove(*parts, known)
    whole = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("sid")), sets, words)
    more = verified(pairs, whole)
    remove(whole, pairs)
    fate = materialize(sets.join(more.union(settled).distinct().withColumn("gone", F.lit(True)), "sid", "left").select("sid", "first", F.coalesce("gone", F.lit(False)).alias("gone")), "line-fates")
    remove(sets, settled, more)
    out = words.select("doc_id", "tid", "line_no", "sid").join(fate, "sid").where(F.col("gone") | (F.struct("doc_id", "tid", "line_no") > F.col("first")))
    out = materialize(out.select("doc_id", "tid", "line_no").distinct(), "line-removed")
    remove(words, fate)
    return out


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` for every row: lines with words, and the numbers of the removed lines.

    Lines without a word are never removed; null and empty texts have no lines; rows that share doc_id and text count
    as one document read twice, so they never remove each other's lines, and rows that share an id (or have none) but
    differ in text are documents of their own; a null id comes before all; an empty table gives an empty result.
    Only id and text are read.
    """
    by_doc = removed_lines(docs, id_col, text_col).groupBy(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid")).agg(F.array_sort(F.collect_list("line_no")).alias("removed"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("tid"), F.size(F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n"), lambda s: s.rlike(f"[^{SPACE_CLASS}]"))).alias("n_lines"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tid") == F.col("__tid")), "left").select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the later matching lines taken out of the text (and its length brought up to date)."""
    by_doc = removed_lines(docs, id_col, text_col).groupBy(F.col("doc_id").alias("__id"), F.col("tid").alias("__tid")).agg(F.collect_list("line_no").alias("__removed"))
    joined = docs.join(by_doc, docs[id_col].cast("long").eqNullSafe(F.col("__id")) & (text_key(text_col) == F.col("__tid")), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda s, i: ~F.array_contains(F.col("__removed"), i)), "\n")
    out = joined.withColumn(text_col, F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(kept))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col("__removed").isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(docs.schema[length_col].dataType)))
    return out.select(*docs.columns)
