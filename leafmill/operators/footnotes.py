"""Footnotes: calls in the body, notes below it, which note belongs to which call, and where notes without one go.

Numbers decide most links: within a page and a number, notes and calls meet in order, strong calls first; that is one
window over either side and a join.  Only pages where a note is left over go on to the repair rules, page by page.
Rows carry ``page``; ``note`` and ``call`` number the notes and calls of a page in reading order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .records import match_in_order

#: Marks, closers, raised digits, quote strokes, letters read for the digit one, vowel marks, years and eras.
MARKS, CLOSERS, RAISED, STROKES, ALEFS = ".،؛:؟!,;?", ")]»”", "¹²³⁴⁵⁶⁷⁸⁹⁰", "”“\"'’‘", "اأإآ"
VOWEL_MARKS = "ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۨ-ۭ"
YEARS = {"سنة", "سنه", "عام", "سنتي", "عامي", "سنوات"}
ERAS = {"ه", "هـ", "م", "ق", "ق.", "ق.م", "للهجرة", "هجرية", "ميلادية"}
_D, _AFTER = "0-9٠-٩۰-۹", rf"(?=\s|$|[{re.escape(MARKS)}])"
#: Styles of calls, the first one that takes a stretch of text keeps it; the named group is the call, ``key`` its number.
STYLES = [
    ("bracket", re.compile(rf"(?P<call>[(\[]\s*(?P<key>[{_D}]{{1,3}}|\*{{1,3}})\s*[)\]])")),
    ("lookalike", re.compile(rf"(?P<call>[(\[]\s*[{ALEFS}{STROKES}]?\s*[)\]])")),
    ("lookalike", re.compile(rf"(?<!\S)(?P<call>[(\[]\s*[{ALEFS}{STROKES}]|[{STROKES}]\s*[)\]]){_AFTER}")),
    ("quoted", re.compile(rf"(?:(?<=\s)|(?<=[^\W\d_])|(?<=[{VOWEL_MARKS}»]))(?P<call>[{STROKES}](?:(?P<key>[{_D}]{{1,2}})|[{ALEFS}])[{STROKES}»]){_AFTER}")),
    ("lookalike", re.compile(rf"(?<!\S)(?P<call>[{STROKES}]\s?[{STROKES}]){_AFTER}")),
    ("superscript", re.compile(rf"(?P<call>(?P<key>[{RAISED}]+))")),
    ("glued", re.compile(rf"(?:(?<=[^\W\d_])|(?<=[{VOWEL_MARKS}»”])|(?<=[^\W\d_]\.)|(?<=\s\.))(?P<call>(?P<key>[{_D}]{{1,3}}))(?![{_D}\w])")),
    ("standalone", re.compile(rf"(?<=\s)(?P<call>(?P<key>[{_D}]{{1,2}}))(?=\s|$|[{re.escape(MARKS + CLOSERS)}])")),
    ("alef", re.compile(r"(?:(?<=\s)|(?<=[»”]))(?P<call>(?P<key>ا))(?=\s|$|[.،؛:])")),
]
STRONG = ("bracket", "superscript", "glued", "quoted")
#: Styles and the greatest number of a call that a note may take by its place; a one-digit call that a "1" was hung on.
PLACED, MOST, ONE_DIGIT = ("bracket", "superscript"), 15, 9
CALL = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("key", pa.string()), ("marker", pa.string()), ("style", pa.string()), ("rank", pa.int32()), ("leading", pa.bool_())])
CALLS = "array<struct<start:int,end:int,key:string,marker:string,style:string,rank:int,leading:boolean>>"


def number_of(marker: str) -> str:
    """A marker's number without leading zeros in western digits; stars as they are; the letter alef is 1."""
    if marker.startswith("*") or marker == "ا":
        return "1" if marker == "ا" else marker
    digits = marker.translate(str.maketrans(RAISED + "٠١٢٣٤٥٦٧٨٩" + "۰۱۲۳۴۵۶۷۸۹", "1234567890" + "0123456789" * 2))
    return digits.lstrip("0") or "0"


def _is_text(text: str, start: int, end: int) -> bool:
    """A number of its own that is no call: of a list (a dash follows), or a year (after its word, or before an era's)."""
    before, after = text[:start].split(), text[end:].split()
    dash = re.match(r"\s*[ـ–—-](?:\s|$)", text[end:])
    return bool(dash) or bool(before and re.sub(f"[{VOWEL_MARKS}]", "", before[-1]) in YEARS) or bool(after and after[0].rstrip("،,؛;") in ERAS)


#: For each of the styles the characters of which its calls have one at least: a text without them is not gone through.
NEEDED = [re.compile(f"[{c}]") for c in (r"(\[", r"(\[", rf"(\[)\]{STROKES}", STROKES, STROKES, RAISED, _D, _D, "ا")]


def calls_in(text: str) -> list[dict]:
    """Calls of a block's text in reading order.

    ``rank``: 0 of a strong style, 1 before a mark, a closer or the end, 2 before a word.  ``key`` is empty where the
    number cannot be read.
    """
    taken: list[tuple[int, int]] = []
    found = []
    for (style, pattern), needed in zip(STYLES, NEEDED):
        for m in pattern.finditer(text) if needed.search(text) else ():
            start, end = m.span("call")
            if any(a < end and start < b for a, b in taken) or style == "standalone" and _is_text(text, start, end):
                continue
            taken.append((start, end))
            marker = m.groupdict().get("key")
            own = "lookalike" if style == "quoted" and marker is None else style
            if style == "standalone" and text[:start].rstrip()[-1:] in CLOSERS and text[:start].strip():
                own = "quoted"
            rest = text[end:].lstrip()
            rank = 0 if own in STRONG else 1 if not rest or rest[0] in MARKS + CLOSERS else 2
            key = number_of(marker) if marker and own != "lookalike" else ""
            found.append({"start": start, "end": end, "key": key, "marker": marker or text[start:end], "style": own, "rank": rank, "leading": not text[:start].strip()})
    return sorted(found, key=lambda c: c["start"])


def find_calls(blocks: DataFrame, page: str = "page", block: str = "block", text: str = "text") -> DataFrame:
    """``page, block, call, start, end, key, marker, style, rank, leading`` of a table of the text that a block has on a page.

    Blocks of a page are read in their order.  A null or empty text has no calls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([calls_in(t or "") for t in batch.column(2).to_pylist()], pa.list_(CALL))], names=[page, block, "c"])

    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    found = blocks.select(page, block, text).mapInArrow(run, f"{page} {types[page]}, {block} {types[block]}, c {CALLS}")
    each = found.select(page, block, F.posexplode("c").alias("nth", "c"))
    order = F.row_number().over(Window.partitionBy(page).orderBy(block, "nth")) - 1
    return each.select(page, block, order.alias("call"), "c.*")


def marker_of(line: Column) -> Column:
    """``struct<key, bracketed, size>`` of the marker that opens a note line, null where none does."""
    head = rf"^\s*[(\[]?\s*([{_D}]{{1,3}}|\*{{1,3}}|ا(?=[\s)\]]))\s*[)\]]?\s*[-–—ـ.:،]?(?:\s+|$)"
    marker, whole = F.regexp_extract(line, head, 1), F.regexp_extract(line, head, 0)
    number = F.regexp_replace(T.to_western_digits(marker), "^0+(?=.)", "")
    bracketed = whole.rlike(r"[(\[]")
    after = F.rtrim(F.regexp_extract(F.substr(line, F.length(whole) + 1), r"^\s*(\S+)", 1), F.lit("،,؛;"))
    key = F.when(marker == "ا", "1").otherwise(number)
    return F.when((marker != "") & (bracketed | ~after.isin(*ERAS)), F.struct(key.alias("key"), bracketed.alias("bracketed"), F.length(whole).alias("size")))


def parse_notes(lines: DataFrame, calls: DataFrame, page: str = "page", book: str = "book", number: str = "number") -> DataFrame:
    """``page, note, key, text, from_page``: notes of the lines ``book, number, page, line, text``.

    A line that a marker opens is a note; others go on with the note before.  On a page with bracketed markers a bare
    number opens a note only if it is one more than the last and below the next bracketed one; elsewhere a bare number of
    two digits or more must be in sequence, and so must a bracketed one after the first.  Lines above a page's first note
    go on with the last note of the page before (``from_page``), if that page is the one before and has notes, and they
    begin with "=", or the first note below is 1 or one more than that note (but not 2), or that note's text does not
    end a sentence and the page has no call left that a note without number may take; else they are a note without one.
    Sequence is judged within the page.
    """
    own = Window.partitionBy(page).orderBy("line")
    m = lines.where(F.trim("text") != "").withColumn("m", marker_of(F.col("text")))
    value = F.when(F.col("m.key").rlike("^[0-9]{1,3}$"), F.col("m.key").cast("int"))
    m = m.withColumn("v", value).withColumn("strong", F.coalesce("m.bracketed", F.lit(False)))
    m = m.withColumn("any_strong", F.max("strong").over(Window.partitionBy(page))).withColumn("below", F.min(F.when(F.col("strong") & F.col("v").isNotNull(), F.struct("line", "v"))).over(own.rowsBetween(1, Window.unboundedFollowing))["v"])
    # The last number so far: a marker counts once it is known to open a note, so the first pass takes the sure ones.
    sure = F.when(F.col("strong") | ((F.length("m.key") == 1) & ~F.col("any_strong")), F.col("v"))
    m = m.withColumn("last", F.last(sure, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    in_order = F.when(F.col("last").isNull(), F.col("v") == 1).otherwise(F.col("v") == F.col("last") + 1)
    loose = F.col("any_strong") & ~F.col("strong")
    opens = F.col("m").isNotNull() & F.when(F.col("v").isNull(), True).when(loose, in_order & F.coalesce(F.col("v") < F.col("below"), F.lit(True))).when(~F.col("strong"), (F.col("v") < 10) | in_order).otherwise((F.col("v") < 10) | F.col("last").isNull() | in_order | (F.col("v") == (F.col("last") + 1) * 10 + 1))
    m = m.withColumn("opens", opens).withColumn("nth", F.sum(F.col("opens").cast("int")).over(own))
    rest = F.when(F.col("opens"), F.substr("text", F.col("m.size") + 1)).otherwise(F.col("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.trim(rest).alias("t")))), lambda x: x["t"]), " ")
    parts = m.groupBy(book, number, page, "nth").agg(F.max(F.when(F.col("opens"), F.col("m.key"))).alias("key"), F.bool_or("opens").alias("opens"), joined.alias("text"))
    # What each page leaves to the next, and what a page's first lines find there.
    ends = m.groupBy(book, number, page).agg(F.max_by("text", "line").alias("tail"), F.max_by("m.key", F.when(F.col("opens"), F.col("line"))).alias("tail_key"), F.min_by(F.when(F.col("opens"), F.col("v")), F.when(F.col("opens") & F.col("strong"), F.col("line"))).alias("first"))
    w = Window.partitionBy(book).orderBy(number)
    follows = F.lag(number).over(w) == F.col(number) - 1
    carried = ends.select(page, "first", *[F.when(follows, F.lag(c).over(w)).alias(n) for c, n in (("tail", "before"), ("tail_key", "before_key"), (page, "before_page"))])
    keys = m.where("opens").select(page, F.col("m.key").alias("key"), F.row_number().over(Window.partitionBy(page, "m.key").orderBy("line")).alias("k"))
    loose_calls = open_calls(calls, keys, page).groupBy(page).agg(F.count("*").alias("open"))
    head = parts.join(carried, page, "left").join(loose_calls, page, "left")
    goes_on = F.col("text").rlike(r"^\s*=") | F.coalesce((F.col("first") == 1) | ((F.col("first") != 2) & (F.col("first") == F.col("before_key").cast("int") + 1)), F.lit(False)) | (F.coalesce("open", F.lit(0)) == 0) & ~T.ends_terminal(F.col("before"))
    goes_on = ~F.col("opens") & F.col("before").isNotNull() & goes_on
    notes = head.withColumn("from_page", F.when(goes_on, F.col("before_page")))
    order = F.row_number().over(Window.partitionBy(page).orderBy("nth")) - 1
    return notes.select(page, order.alias("note"), "key", F.regexp_replace("text", r"^\s*=\s*", "").alias("text"), "from_page")


def placed(call: Column, smallest: Column) -> Column:
    """A call that a note without number may take by its place: bracketed or raised, not opening its block, stars or a
    small number below the smallest of the page's notes."""
    value = F.when(call["key"].rlike("^[0-9]{1,3}$"), call["key"].cast("int"))
    return call["style"].isin(*PLACED) & ~call["leading"] & (call["key"].startswith("*") | F.coalesce(value.between(1, MOST) & (smallest.isNull() | (value < smallest)), F.lit(False)))


def open_calls(calls: DataFrame, keys: DataFrame, page: str) -> DataFrame:
    """Calls of ``page`` that a note without number could take: each of ``keys(page, key, k)`` has its k-th strong call."""
    own = calls.where(F.col("style").isin(*STRONG) & ~F.col("leading")).withColumn("k", F.row_number().over(Window.partitionBy(page, "key").orderBy("call")))
    small = keys.groupBy(page).agg(F.min(F.when(F.col("key").rlike("^[0-9]{1,3}$"), F.col("key").cast("int"))).alias("smallest"))
    left = own.join(keys, [page, "key", "k"], "left_anti").join(small, page, "left")
    return left.where(placed(F.struct("key", "style", "leading"), F.col("smallest"))).select(page, "call")


def _small(key: str | None) -> bool:
    return key is None or key.isdigit() and 1 <= int(key) <= MOST


def repair(notes: list[tuple], calls: list[tuple]) -> list[tuple[int, int, str]]:
    """Links of one page's notes left over: ``(note, call, how)``.

    ``notes``: ``(note, key, call or None)`` and ``calls``: ``(call, key, style, leading, used)``, in reading order.
    ``hung``: a one-digit note takes the bracketed call that has a 1 after its number.  ``place``: a note without number
    takes the first call it may take by its place.  ``lookalike`` and ``misread``: what is left pairs with calls whose
    number cannot be read, then with small numbers that no note has, if there are as many and every call lies between
    those of the notes around its note.
    """
    at = {n: c for n, _, c in notes if c is not None}
    free = {c: (key, style) for c, key, style, leading, used in calls if not leading and not used}
    keys, left, out = [k for _, k, _ in notes if k is not None], [(n, k) for n, k, c in notes if c is None], []

    def link(n: int, c: int, how: str) -> None:
        out.append((n, c, how))
        at[n] = c
        del free[c]

    for n, k in left:
        if k and k.isdigit() and 1 <= int(k) <= ONE_DIGIT and k + "1" not in keys:
            c = next((c for c, x in free.items() if x == (k + "1", "bracket")), None)
            if c is not None:
                link(n, c, "hung")
    smallest = min((int(k) for k in keys if k.isdigit()), default=None)
    places = [c for c, (k, style) in free.items() if style in PLACED and (k.startswith("*") or k.isdigit() and 1 <= int(k) <= MOST and (smallest is None or int(k) < smallest))]
    for (n, _), c in zip([x for x in left if x[1] is None], places):
        link(n, c, "place")
    for how in ("lookalike", "misread"):
        wanting = [n for n, k in left if n not in at and _small(k)]
        having = {k for n, k, _ in notes if n not in at and k} - {k for n, k, _ in notes if n in at}
        fits = [c for c, (k, style) in free.items() if (style == "lookalike" if how == "lookalike" else style in PLACED and k.isdigit() and 1 <= int(k) <= MOST and k not in having)]
        between = all((m < n) == (x < c) for n, c in zip(wanting, fits) for m, x in at.items())
        if len(wanting) == len(fits) and between:
            for n, c in zip(wanting, fits):
                link(n, c, how)
    return out


def link(notes: DataFrame, calls: DataFrame, page: str = "page") -> DataFrame:
    """``page, note, call, how``: every note of ``notes(page, note, key, from_page)`` that begins on its page.

    ``how``: ``number`` for a call of the note's number (strong ones first, then those before a mark, then those before a
    word; each call once), else the repair rule; null, without a call, for an orphan.
    """
    own = notes.where("from_page IS NULL").select(page, "note", "key")
    direct = match_in_order(own.where("key IS NOT NULL"), calls.where("key <> ''"), [page, "key"], ["note"], ["rank", "call"]).select(page, "note", "call")
    met = own.join(direct, [page, "note"], "left")
    pages = met.where("call IS NULL").select(page).distinct()
    listed = lambda df, name, *cols: df.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    used = direct.where("call IS NOT NULL").select(page, "call", F.lit(True).alias("used"))
    of_page = calls.join(pages, page, "left_semi").join(used, [page, "call"], "left").withColumn("used", F.coalesce("used", F.lit(False)))
    left = listed(met.join(pages, page, "left_semi"), "notes", "note", "key", "call").join(listed(of_page, "calls", "call", "key", "style", "leading", "used"), page, "left")
    kind = notes.schema[page].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *x) for p, n, c in zip(*[batch.column(k).to_pylist() for k in range(3)]) for x in repair([tuple(v.values()) for v in n], [tuple(v.values()) for v in c or []])]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=[page, "note", "repaired", "rule"])

    more = left.select(page, "notes", "calls").mapInArrow(run, f"{page} {kind}, note int, repaired int, rule string")
    both = met.join(more, [page, "note"], "left")
    return both.select(page, "note", F.coalesce("call", "repaired").alias("call"), F.when(F.col("call").isNotNull(), "number").otherwise(F.col("rule")).alias("how"))


def warnings(links: DataFrame, calls: DataFrame, page: str = "page") -> DataFrame:
    """``page, code, note, call``: repaired links, links by place, orphans, and strong calls left on pages with notes."""
    code = F.when(F.col("how").isNull(), "note_orphan").when(F.col("how") == "place", "note_marker_missing").when(F.col("how") != "number", "note_call_repaired")
    of_notes = links.select(page, code.alias("code"), "note", "call").where("code IS NOT NULL")
    strong = calls.where(F.col("style").isin(*STRONG)).select(page, "call")
    left = strong.join(links.select(page).distinct(), page, "left_semi").join(links.where("call IS NOT NULL").select(page, "call"), [page, "call"], "left_anti")
    return of_notes.unionByName(left.select(page, F.lit("marker_unmatched").alias("code"), F.lit(None).cast("int").alias("note"), "call"))


def hosts(orphans: DataFrame, blocks: DataFrame, page: str = "page", book: str = "book", number: str = "number") -> DataFrame:
    """``page, note, block, placed``: the block that each orphan ``(book, number, page, note)`` is put behind.

    The last block of its page; else the nearest block before in the book, else after; null where the book has none.
    ``placed`` numbers the orphans of a block in their order.
    """
    of_page = blocks.groupBy(book, number).agg(F.max("block").alias("last"), F.min("block").alias("first"))
    pages = orphans.select(book, number).unionByName(of_page.select(book, number)).distinct().join(of_page, [book, number], "left")
    w = Window.partitionBy(book).orderBy(number)
    before = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("first", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    at = pages.select(book, number, F.coalesce("last", before, after).alias("block"))
    order = F.row_number().over(Window.partitionBy(book, "block").orderBy(number, "note")) - 1
    return orphans.join(at, [book, number]).select(page, "note", "block", F.when(F.col("block").isNotNull(), order).alias("placed"))


def strays(blocks: DataFrame, calls: DataFrame, links: DataFrame, page: str = "page") -> DataFrame:
    """``page, block, key, warned``: paragraphs of one page that open like a note whose call is still open there.

    ``warned`` if they stand in the run of such paragraphs that ends the page, unless that is the whole page.
    """
    head = rf"^\s*[(\[]\s*([{_D}]{{1,3}}|\*{{1,3}})\s*[)\]]\s*[-–.:،]?\s*"
    marker = F.when(F.regexp_replace("text", head, "").rlike(r"\p{L}"), F.regexp_extract("text", head, 1))
    w = Window.partitionBy(page)
    rows = blocks.select(page, "block", F.when(marker != "", F.regexp_replace(T.to_western_digits(marker), "^0+(?=.)", "")).alias("key"))
    rows = rows.withColumn("last_text", F.max(F.when(F.col("key").isNull(), F.col("block"))).over(w))
    open_ = calls.where(F.col("style").isin(*STRONG) & ~F.col("leading")).join(links.where("call IS NOT NULL").select(page, "call"), [page, "call"], "left_anti").select(page, "key").distinct()
    return rows.where("key IS NOT NULL").join(open_, [page, "key"], "left_semi").select(page, "block", "key", (F.col("block") > F.coalesce("last_text", F.lit(1 << 60))).alias("warned"))
