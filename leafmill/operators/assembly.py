"""A manuscript from a book's pages: pages chosen, lines as paragraphs, paragraphs over page breaks, notes, headings, warnings.

Lines are compared with their neighbours within a page.  What a page hands to the next (its last line, whether its
first paragraph goes on) is one row a page, so windows over a book see pages and never lines, and a paragraph's lines
come together by the page and place where it begins.

``pages(book, number, page, status)`` with ``override`` (join, split or null) if there is one; ``lines(page, line, kind,
role, text)`` with ``style``, ``x0``, ``x1`` (shares of the page) and ``doubtful`` (words) where there are any.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import materialize
from . import footnotes, library, review

#: Shares of the measure from which a line is indented, short, or centred (both gaps, and how like they are).
INDENT, SHORT, CENTRED, BALANCE = 0.02, 0.06, 0.06, 0.35
LEVELS = {"heading": 1, "subheading": 2}
#: A suggested heading has so many lines and words at most.
MOST_LINES, MOST_WORDS = 2, 8
#: The order in which warnings are listed.
CODES = ["no_headings", "page_pending", "page_error", "page_unreviewed", "empty_page", "running_head", "marker_unmatched", "note_orphan", "note_marker_missing", "note_call_repaired", "stray_note", "uncertain_words"]


class Manuscript(NamedTuple):
    """Tables of an assembled book: paragraphs, page seams, notes with their calls, warnings in order, and counts."""

    blocks: DataFrame
    seams: DataFrame
    notes: DataFrame
    warnings: DataFrame
    statistics: DataFrame


def _with(df: DataFrame, **types: str) -> DataFrame:
    """``df`` with null columns for those of ``types`` that it lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def shaped(lines: DataFrame) -> DataFrame:
    """``lines`` with ``shape`` (indented, short, centred) by the page's measure; null without a box or a measure.

    Text begins at the right: the indent is the gap there, and a short line leaves a gap at the left.
    """
    boxed = lines.where(F.col("x1") > F.col("x0"))
    at = library.measure(boxed, "page", "x0", "x1").where(F.col("right") > F.col("left"))
    out = lines.join(at, "page", "left")
    start, end, width = F.col("right") - F.col("x1"), F.col("x0") - F.col("left"), F.col("right") - F.col("left")
    centred = (start > CENTRED * width) & (end > CENTRED * width) & (F.abs(start - end) < BALANCE * F.greatest(start, end))
    shape = F.struct((start > INDENT * width).alias("indented"), (end > SHORT * width).alias("short"), centred.alias("centred"))
    return out.withColumn("shape", F.when(start.isNotNull() & end.isNotNull(), shape)).withColumn("width", width).drop("left", "right")


def ends_on_word(text: Column) -> Column:
    """The text ends on a bare word: nothing but letters and their marks after the last space."""
    return F.rtrim(text).rlike(r"(?<![^\s])[\x{0621}-\x{064A}\x{066E}-\x{06D3}][\x{0610}-\x{061A}\x{0621}-\x{065F}\x{066E}-\x{06DC}]*$")


def breaks(before: Column, own: Column) -> Column:
    """Whether a paragraph ends between two lines that follow each other (structs of the columns of :func:`shaped`)."""
    a, b = before["shape"], own["shape"]
    left_of = F.when(before["x1"].isNotNull() & own["x1"].isNotNull(), before["x1"] - own["x1"] > INDENT * own["width"]).otherwise(True)
    indented = b["indented"] & left_of & ~ends_on_word(before["text"])
    by_place = F.when(a.isNull() | b.isNull(), T.ends_terminal(before["text"])).otherwise(a["short"] | indented | a["centred"] | b["centred"])
    same = (before["role"] == own["role"]) & (own["role"] != "verse")
    return F.when(~same, True).when(own["role"].isin(*LEVELS), False).when(~before["style"].eqNullSafe(own["style"]), True).otherwise(by_place)


def paragraphs(lines: DataFrame) -> DataFrame:
    """Body lines with text, with ``idx``, the number of their paragraph on the page, from 0."""
    body = _with(lines, style="string", x0="double", x1="double", doubtful="int").where((F.col("kind") != "footnote") & (F.trim("text") != ""))
    row = F.struct("role", "style", "text", "x1", "width", "shape")
    w = Window.partitionBy("page").orderBy("line")
    s = shaped(body).withColumn("row", row).withColumn("before", F.lag(row).over(w))
    begins = F.col("before").isNotNull() & breaks(F.col("before"), F.col("row"))
    return s.withColumn("idx", F.sum(begins.cast("int")).over(w)).drop("row", "before", "width")


def seams(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """For each page of ``pages(book, number, page, gap, override)`` but a book's first: ``book, number, from_number, mode,
    decision, reason, skipped``.

    Two paragraphs join if the last line is not short and the next not indented; without boxes, if the last does not end
    a sentence.  Headings, verse and different styles never join, nor does anything over skipped pages; an override holds
    between paragraphs.
    """
    edge = F.struct("role", "style", "text", "shape", "idx")
    ends = lines.groupBy("page").agg(F.min_by(edge, "line").alias("first"), F.max_by(edge, "line").alias("last"))
    p = _with(pages, override="string").join(ends, "page", "left")
    w = Window.partitionBy("book").orderBy("number")
    p = p.withColumn("from_number", F.lag("number").over(w)).withColumn("prev", F.lag("last").over(w)).where("from_number IS NOT NULL")
    a, b = F.col("prev"), F.col("first")
    heading = a.isNull() | b.isNull() | a["role"].isin(*LEVELS) | b["role"].isin(*LEVELS)
    missing = F.size(F.coalesce("gap", F.array())) > 0
    fixed = F.when(missing, "skipped_page").when(heading, "heading").when((a["role"] == "verse") | (b["role"] == "verse"), "verse").when(~a["style"].eqNullSafe(b["style"]), "style")
    boxed = a["shape"].isNotNull() & b["shape"].isNotNull()
    joins = F.when(boxed, ~a["shape"]["short"] & ~b["shape"]["indented"]).otherwise(~T.ends_terminal(a["text"]))
    free = fixed.isNull()
    told = free & F.col("override").isin("join", "split")
    mode = F.when(missing, "missing").when(~free, "split").when(told, F.col("override")).otherwise(F.when(joins, "join").otherwise("split"))
    reason = F.coalesce(fixed, F.when(boxed, "geometry").otherwise("punctuation"))
    return p.select("book", "number", "page", "from_number", mode.alias("mode"), F.when(told, "override").otherwise("auto").alias("decision"), reason.alias("reason"), F.when(missing, F.col("gap")).alias("skipped"))


def origins(pages: DataFrame, lines: DataFrame, joined: DataFrame) -> DataFrame:
    """``page, at_number, at_idx``: where the first paragraph of each page with text begins.

    A page that is one paragraph, joined to the page before, hands that paragraph on; else its own last one.
    """
    last = lines.groupBy("page").agg(F.max("idx").alias("last"))
    p = pages.select("book", "number", "page").join(last, "page").join(joined.where("mode = 'join'").select("page", F.lit(True).alias("joins")), "page", "left")
    w = Window.partitionBy("book").orderBy("number")
    hands = F.when(~(F.coalesce("joins", F.lit(False)) & (F.col("last") == 0)), F.struct("number", F.col("last").alias("idx")))
    source = F.last(hands, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("source", F.when(F.col("joins"), source))
    return p.select("page", F.coalesce("source.number", "number").alias("at_number"), F.coalesce("source.idx", F.lit(0)).alias("at_idx"))


def blocks(pages: DataFrame, lines: DataFrame, joined: DataFrame) -> DataFrame:
    """``book, number, idx, kind, level, style, lines, pages, words, text, suggested``: paragraphs by the page they begin on.

    ``suggested``: a paragraph of one or two centred lines and eight words at most that does not end a sentence, with a
    paragraph after it, may be a heading.
    """
    at = lines.join(pages.select("book", "number", "page"), "page").join(origins(pages, lines, joined), "page")
    first = F.col("idx") == 0
    at = at.withColumn("to_number", F.when(first, F.col("at_number")).otherwise(F.col("number"))).withColumn("to_idx", F.when(first, F.col("at_idx")).otherwise(F.col("idx")))
    own = F.array_sort(F.collect_list(F.struct("number", "line", "page", "text", "idx")))
    b = at.groupBy("book", "to_number", "to_idx").agg(own.alias("x"), F.min_by("role", F.struct("number", "line")).alias("role"), F.min_by("style", F.struct("number", "line")).alias("style"), F.bool_and(F.coalesce("shape.centred", F.lit(False))).alias("centred"))
    text = F.array_join(F.transform("x", lambda r: F.trim(r["text"])), " ")
    level = F.when(F.col("role") == "heading", LEVELS["heading"]).when(F.col("role") == "subheading", LEVELS["subheading"]).otherwise(0)
    b = b.select("book", F.col("to_number").alias("number"), F.col("to_idx").alias("idx"), F.when(level > 0, "heading").otherwise("paragraph").alias("kind"), level.alias("level"), F.when(F.col("role") == "verse", "verse").otherwise(F.col("style")).alias("style"), F.struct(F.element_at("x", -1)["page"].alias("page"), F.element_at("x", -1)["idx"].alias("idx")).alias("end"), F.transform("x", lambda r: r["line"]).alias("lines"), F.array_distinct(F.transform("x", lambda r: r["number"])).alias("pages"), "centred", text.alias("text"))
    # The block after: the next one of the page that this one ends on, else the first of the next page with text.
    role = lines.groupBy("page", "idx").agg(F.min_by("role", "line").alias("role"))
    on_page = role.select("page", (F.col("idx") - 1).alias("idx"), F.col("role").alias("next_role"))
    w = Window.partitionBy("book").orderBy("number").rowsBetween(1, Window.unboundedFollowing)
    beyond = pages.join(role.where("idx = 0").select("page", "role"), "page", "left").select("page", F.first("role", ignorenulls=True).over(w).alias("beyond"))
    b = b.withColumn("page", F.col("end.page")).withColumn("at", F.col("end.idx"))
    b = b.join(on_page.withColumnRenamed("idx", "at"), ["page", "at"], "left").join(beyond, "page", "left").withColumn("after", F.coalesce("next_role", "beyond"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    may = (F.col("kind") == "paragraph") & F.col("style").isNull() & (F.size("lines") <= MOST_LINES) & F.col("centred") & words.between(1, MOST_WORDS) & ~T.ends_sentence(F.col("text")) & F.col("after").isNotNull() & ~F.col("after").isin(*LEVELS)
    return b.select("book", "number", "idx", "kind", "level", "style", "lines", "pages", words.alias("words"), "text", F.coalesce(may, F.lit(False)).alias("suggested"))


def without_heads(lines: DataFrame, pages: DataFrame, heads: DataFrame) -> DataFrame:
    """``lines`` less the first body line of each page whose key is among ``heads(book, key)``."""
    w = Window.partitionBy("page").orderBy("line")
    body = lines.where((F.col("kind") != "footnote") & (F.trim("text") != "")).withColumn("n", F.row_number().over(w)).where("n = 1")
    keyed = body.join(pages.select("page", "book"), "page").select("page", "line", "book", T.head_key(F.col("text")).alias("key"))
    gone = keyed.join(heads.select("book", "key").distinct(), ["book", "key"], "left_semi").select("page", "line")
    return lines.join(gone, ["page", "line"], "left_anti")


def assemble(pages: DataFrame, lines: DataFrame, include_unreviewed: bool = True, heads: DataFrame | None = None) -> Manuscript:
    """The whole chain.  Pages without text give no block; a book without pages that are included gives page warnings alone."""
    chosen = review.select_pages(pages, include_unreviewed)
    included = materialize(_with(chosen.where("included"), override="string").select("book", "number", "page", "gap", "override"), "pages")
    of = lines if heads is None else materialize(without_heads(lines, included, heads), "lines")
    body = materialize(paragraphs(of.join(included.select("page"), "page", "left_semi")), "body")
    joined = materialize(seams(included, body), "seams")
    made = materialize(blocks(included, body, joined), "blocks")

    goes_on = joined.where("mode = 'join'").select("page", F.lit(0).alias("block"), F.lit(True).alias("goes_on"))
    segments = body.groupBy("page", F.col("idx").alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.trim("text").alias("t")))), lambda r: r["t"]), " ").alias("text"))
    calls = footnotes.find_calls(segments).join(goes_on, ["page", "block"], "left")
    calls = materialize(calls.withColumn("leading", F.col("leading") & F.col("goes_on").isNull()).drop("goes_on"), "calls")
    # A skipped page ends a note that would go on, as a page in between does.
    gap = F.sum(F.coalesce(F.size("gap"), F.lit(0))).over(Window.partitionBy("book").orderBy("number"))
    counted = included.select("book", "page", (F.row_number().over(Window.partitionBy("book").orderBy("number")) + gap).alias("number"))
    below = lines.where("kind = 'footnote'").select("page", "line", "text").join(counted, "page")
    notes = materialize(footnotes.parse_notes(below, calls), "notes")
    links = materialize(footnotes.link(notes, calls), "links")

    where = included.select("book", "number", "page")
    told = [
        chosen.where("warning IS NOT NULL").select("book", "number", F.col("warning").alias("code"), F.lit(None).cast("string").alias("of")),
        where.join(body.select("page").distinct(), "page", "left_anti").select("book", "number", F.lit("empty_page").alias("code"), F.lit(None).cast("string").alias("of")),
        footnotes.warnings(links, calls).join(where, "page").select("book", "number", "code", F.coalesce(F.concat(F.lit("note "), F.col("note")), F.concat(F.lit("call "), F.col("call"))).alias("of")),
        footnotes.strays(segments, calls, links).where("warned").join(where, "page").select("book", "number", F.lit("stray_note").alias("code"), F.concat(F.lit("block "), F.col("block")).alias("of")),
        made.groupBy("book").agg(F.count_if(F.col("kind") == "heading").alias("n")).where("n = 0").select("book", F.lit(None).cast("int").alias("number"), F.lit("no_headings").alias("code"), F.lit(None).cast("string").alias("of")),
        _with(of, doubtful="int").join(where, "page").groupBy("book", "number").agg(F.sum("doubtful").alias("n")).where("n > 0").select("book", "number", F.lit("uncertain_words").alias("code"), F.col("n").cast("string").alias("of")),
    ]
    if heads is not None:
        gone = lines.join(of, ["page", "line"], "left_anti").join(where, "page")
        told.append(gone.groupBy("book", T.head_key(F.col("text")).alias("of")).agg(F.min("number").alias("number")).select("book", "number", F.lit("running_head").alias("code"), "of"))
    listed = told[0]
    for more in told[1:]:
        listed = listed.unionByName(more)
    order = F.array_position(F.array(*[F.lit(c) for c in CODES]), F.col("code")).cast("int")
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("book").orderBy(order, F.col("number").asc_nulls_first(), F.col("of").asc_nulls_first())))

    by_book = pages.groupBy("book").agg(F.count_if(F.col("status") != "excluded").alias("pages"))
    parts = [
        (included.groupBy("book").agg(F.count("*").alias("included")), ["included"]),
        (made.groupBy("book").agg(F.count_if(F.col("kind") == "paragraph").alias("paragraphs"), F.count_if(F.col("kind") == "heading").alias("headings"), F.sum("words").alias("words"), F.count_if("suggested").alias("suggested")), ["paragraphs", "headings", "words", "suggested"]),
        (joined.groupBy("book").agg(F.count_if(F.col("mode") == "join").alias("joins"), F.count_if(F.col("mode") == "split").alias("splits"), F.count_if(F.col("mode") == "missing").alias("missing")), ["joins", "splits", "missing"]),
        (links.join(where, "page").groupBy("book").agg(F.count("*").alias("notes"), F.count_if(F.col("call").isNull()).alias("orphans")), ["notes", "orphans"]),
        (listed.groupBy("book").agg(F.count("*").alias("warnings")), ["warnings"]),
    ]
    counts, names = by_book, ["pages"]
    for df, cols in parts:
        counts, names = counts.join(df, "book", "left"), names + cols
    counts = counts.select("book", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])
    return Manuscript(made, joined.drop("page"), links.join(notes.select("page", "note", "key", "text"), ["page", "note"]), ranked, counts)
