"""Reading quality and review: flag policy, voting, sanity of a reading, merge decisions, corpus find and fix."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Letters of other scripts, stray symbols, Arabic and Latin letters, and a letter that looks like a digit.
FOREIGN = "[Ͱ-ϿЀ-ӿ֐-׿぀-ヿ一-鿿가-힯]"
STRANGE = "[※★∩∧∨≡→©¢€¥\\^]"
ARABIC, LATIN = "[ء-يٮ-ۓ]", "[A-Za-z]"
LONE_LETTER = r"^[(\[«]?[اأإآهع]{1,2}ـ?[)\]»]?[.،:؛]?$"
#: Confidence for a one-reader flag; bounds of a reading's length against its reference and its least word F1.
SINGLE, LOW, HIGH, SLACK, LEAST_F1, ENOUGH = 85, 0.2, 1.8, 3, 0.45, 15
SHORT_RATIO, SHORT_SLACK, NO_REFERENCE = 3, 10, 3
#: Status values of a page in assembly.
REVIEWED = ("reviewed", "assembled")


def _digits(c: Column) -> Column:
    return F.regexp_replace(T.to_western_digits(c), "[^0-9]", "")


def flag(t: Column, second: Column, tess: Column, conf: Column, boxed: Column, two: Column) -> Column:
    """Why a token is doubtful, null when it is sure; the first rule that applies decides.

    ``second`` is the other model's reading, ``tess`` the third reader's word where it differs, ``boxed`` whether that
    reader saw a word there, ``two`` whether two models read the region (null: nothing to compare with).
    """
    mixed = t.rlike(ARABIC) & t.rlike(LATIN)
    value = _digits(t)
    third = F.when(F.coalesce(tess, F.lit("")) != "", _digits(tess)).when(boxed, value)
    agreed = ~t.rlike("[٠-٩۰-۹]") & (value != "") & F.coalesce(_digits(second) == value, F.lit(False)) & F.coalesce(third == value, F.lit(False))
    arabic = lambda c: c.rlike(ARABIC) & ~c.rlike(LATIN)
    single = F.coalesce(arabic(tess) & arabic(t) & (conf >= SINGLE) & (T.lenient(tess) != T.lenient(t)) & (T.skeleton(tess) != T.skeleton(t)), F.lit(False))
    differs = (t != second) & (T.lenient(t) != T.lenient(second))
    by_reader = F.when(two.isNull(), None).when(~two, F.when(single, "single")).when(second.isNull(), F.when(~(boxed & (F.coalesce(tess, F.lit("")) == "")), "alone")).otherwise(F.when(differs, "disagree"))
    # A word of plain Latin letters has no strange sign, digit or lone Arabic letter: only the readers are compared.
    return F.when(t.rlike(T.LETTERS), by_reader).otherwise(
        F.when(t.rlike(FOREIGN) | t.rlike(STRANGE) | mixed, "script")
        .when(T.is_punctuation(t), None)
        .when(T.has_digit(t), F.when(~agreed, "number"))
        .when(T.strip_tashkeel(t).rlike(LONE_LETTER), None)
        .otherwise(by_reader)
    )


def vote(t: Column, alt: Column, tess: Column, digit: Column, settled: Column) -> Column:
    """The other model's word where the third reader backs it against the text; never for numbers or lone letters."""
    barred = settled | digit | T.has_digit(t) | T.strip_tashkeel(t).rlike(LONE_LETTER)
    backed = (T.lenient(alt) != "") & (T.lenient(tess) == T.lenient(alt)) & (T.lenient(alt) != T.lenient(t))
    return F.when(~F.coalesce(barred, F.lit(False)) & F.coalesce(backed, F.lit(False)), alt)


def sanity(words: Column, reference: Column, f1: Column, looped: Column) -> Column:
    """``ok, reason`` of a reading: word counts of the reading and its reference, their word F1, and loops."""
    w, r = words, reference
    reason = (
        F.when(looped, "loop").when(w == 0, "empty").when(r == 0, "no_reference")
        .when((r < ENOUGH) & (w > SHORT_RATIO * r + SHORT_SLACK), "too_long").when(r < ENOUGH, "short_reference")
        .when(w < LOW * r, "too_short").when(w > HIGH * r + SLACK, "too_long").when(f1 < LEAST_F1, "low_overlap").otherwise("ok")
    )
    return F.struct((reason.isin("ok", "short_reference") | (reason == "no_reference") & (w <= NO_REFERENCE)).alias("ok"), reason.alias("reason"))


def word_f1(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, f1`` of two word arrays a row: a multiset intersection (0 when both are empty)."""
    words = pairs.select(key, F.explode(a).alias("w"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(pairs.select(key, F.explode(b).alias("w"), F.lit(0), F.lit(1)))
    counts = words.groupBy(key, "w").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    sums = counts.groupBy(key).agg(F.sum(F.least("x", "y")).alias("c"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    return pairs.select(key).join(sums, key, "left").select(key, F.coalesce(2.0 * F.col("c") / (F.col("x") + F.col("y")), F.lit(0.0)).alias("f1"))


def shared_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, n`` of rows ``key, a, b``: the size of the multiset intersection of two texts' words (one space apart)."""
    for batch in batches:
        a, b = (batch.column(k).to_pylist() for k in (1, 2))
        n = [(Counter(x.split(" ")) & Counter(y.split(" "))).total() for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n"])


def merge_decision(mine: Column, base: Column, fresh: Column, known: Column, added: Column) -> Column:
    """What a change plan does with a block: empty strings stand for blocks that are not there.

    ``known``: the base exists and touches no page unknown to it; ``added``: the block's page is new.  ``merge`` goes
    on to a three-way merge of the texts.
    """
    no = lambda c: F.coalesce(c, F.lit("")) == ""
    same = lambda a, b: F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))
    return (
        F.when(same(mine, fresh), "nothing")
        .when(no(mine), F.when(known & ~no(base), F.when(same(base, fresh), "nothing").otherwise("conflict")).when(known | added, "insert").otherwise("choose"))
        .when(no(fresh), F.when(known, F.when(same(mine, base), "remove").otherwise("conflict")).otherwise("choose"))
        .when(~known, "choose").when(same(mine, base), "take").when(same(fresh, base), "nothing").otherwise("merge")
    )


def select_pages(pages: DataFrame, include_unreviewed: bool) -> DataFrame:
    """``pages(book, number, status)`` without excluded ones, with ``included``, a ``warning`` and the ``gap`` before.

    ``gap`` lists the skipped pages between an included page and the included one before it.
    """
    rows = pages.where("status <> 'excluded'")
    included = F.col("status").isin(*REVIEWED) | (F.lit(include_unreviewed) & (F.col("status") == "ocr_done"))
    warning = F.when(F.col("status") == "ocr_done", "page_unreviewed").when(~included, F.when(F.col("status") == "error", "page_error").otherwise("page_pending"))
    order = Window.partitionBy("book").orderBy("number")
    rows = rows.withColumns({"included": included, "warning": warning}).withColumn("before", F.max(F.when(F.col("included"), F.col("number"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    run = Window.partitionBy("book", "before").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.when(F.col("included") & F.col("before").isNotNull(), F.collect_list(F.when(~F.col("included"), F.col("number"))).over(run))
    return rows.withColumn("gap", gap).drop("before")


def staleness(stored: DataFrame, pages: DataFrame) -> DataFrame:
    """Per book how a manuscript's stored pages differ from now: added, removed, content and approval changes.

    ``stored(book, page, sig, reviewed)`` against ``pages`` of the same columns.
    """
    s, p = (d.select("book", "page", F.col("sig").alias(f"{n}_sig"), F.col("reviewed").alias(f"{n}_reviewed"), F.lit(True).alias(n)) for d, n in ((stored, "s"), (pages, "p")))
    both = s.join(p, ["book", "page"], "full_outer")
    kept = F.col("s").isNotNull() & F.col("p").isNotNull()
    return both.groupBy("book").agg(F.count_if(F.col("s").isNull()).alias("added"), F.count_if(F.col("p").isNull()).alias("removed"), F.count_if(kept & ~F.col("s_sig").eqNullSafe(F.col("p_sig"))).alias("content"), F.count_if(kept & F.col("s_sig").eqNullSafe(F.col("p_sig")) & ~F.col("s_reviewed").eqNullSafe(F.col("p_reviewed"))).alias("approval"))


def find(texts: DataFrame, page: str, text: str, pattern: str, cap: int = 2000) -> DataFrame:
    """Words that match ``pattern`` with five words around: ``page, i, word, before, after, total, truncated``.

    The regular expression runs on whole texts first; the report stops at ``cap`` and says so.
    """
    hit = texts.where(F.col(text).rlike(f"(?i){pattern}")).select(page, F.split(F.trim(text), r"\s+").alias("ws"))
    words = hit.select(page, "ws", F.posexplode("ws").alias("i", "word")).where(F.col("word").rlike(f"(?i)^\\P{{L}}*(?:{pattern})\\P{{L}}*$"))
    near = words.select(page, "i", "word", F.array_join(F.slice("ws", F.greatest(F.col("i") - 4, F.lit(1)), F.least(F.col("i"), F.lit(5))), " ").alias("before"), F.array_join(F.slice("ws", F.col("i") + 2, 5), " ").alias("after"))
    total = near.agg(F.count("*")).scalar()
    return near.orderBy(page, "i").limit(cap).select("*", total.alias("total"), (total > cap).alias("truncated"))


def fix(tokens: DataFrame, picks: DataFrame) -> DataFrame:
    """Applies ``picks(line, i, seen, new)`` to ``tokens(line, i, t, orig, editable)`` where the word still reads ``seen``.

    Adds ``outcome``: applied, changed, page, or null without a pick; the first original is kept.
    """
    joined = tokens.join(picks, ["line", "i"], "left")
    outcome = F.when(F.col("seen").isNull(), None).when(~F.col("editable"), "page").when(F.col("t") != F.col("seen"), "changed").otherwise("applied")
    done = F.coalesce(outcome == "applied", F.lit(False))
    return joined.select("line", "i", F.when(done, F.col("new")).otherwise(F.col("t")).alias("t"), F.when(done, F.coalesce("orig", "t")).otherwise(F.col("orig")).alias("orig"), "editable", outcome.alias("outcome"))


def undoable(revisions: DataFrame, batch: str) -> DataFrame:
    """Lines whose newest live revision belongs to ``batch``, and whether that undo would be safe."""
    order = Window.partitionBy("line").orderBy(F.desc("created_at"), F.desc("id"))
    top = revisions.where("NOT undone").withColumn("r", F.row_number().over(order))
    mine = top.where(F.col("batch") == batch).groupBy("line").agg(F.min("r").alias("r"))
    return mine.select("line", (F.col("r") == 1).alias("undo"))
