"""A library as rows: books with what is indexed of them, passages by their id, words still uncertain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .records import span_state

#: Words shown on either side of an uncertain one.
AROUND = 4


def list_books(books: DataFrame, pages: DataFrame, index: DataFrame) -> DataFrame:
    """``books(book, ...)`` with ``pages``, ``indexed``, ``first_printed``, ``last_printed`` and ``reviewed_share``.

    ``pages(book, page, printed, status)`` without excluded ones count; a page is indexed if it has a row of ``index``;
    the share is of reviewed pages, null for a book without pages.
    """
    own = pages.where("status <> 'excluded'").join(index.select("page", F.lit(True).alias("__in")).distinct(), "page", "left")
    by = own.groupBy("book").agg(F.count("*").alias("pages"), F.count("__in").alias("indexed"), F.min("printed").alias("first_printed"), F.max("printed").alias("last_printed"), F.count_if(F.col("status") == "reviewed").alias("n"))
    out = books.join(by, "book", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*books.columns, zero("pages"), zero("indexed"), "first_printed", "last_printed", F.round(F.try_divide("n", "pages"), 4).alias("reviewed_share"))


def get_passages(index: DataFrame, passages: DataFrame) -> DataFrame:
    """``passage, text, state, words, end_page`` of ``passages(passage)`` by their ids; those that name nothing are left out.

    ``index(book, page, kind, words)``: ``words`` with ``ord``, ``i``, ``text`` and ``state``, in order.  A passage may run on to the
    next page; its text is what lies from its first word to its last.
    """
    p = passages.select("passage", T.parse_passage_id(F.col("passage")).alias("p")).where("p IS NOT NULL")
    p = p.select("passage", "p.*", F.when(F.col("p.kind") == "n", "notes").otherwise("body").alias("__kind"))
    at = p.select("passage", F.col("book").alias("__book"), "__kind", "line", "i", "end_line", "end_i", F.col("page").alias("from_page"), "end_page", F.explode(F.array_distinct(F.array("page", "end_page"))).alias("__page"))
    rows = at.join(index, (F.col("__book") == F.col("book")) & (F.col("__page") == F.col("page")) & (F.col("__kind") == F.col("kind")))
    place = lambda w: F.struct(w["ord"].cast("long"), w["i"].cast("long"))
    ends = lambda a, b: F.struct(F.col(a), F.col(b))
    within = lambda w: ((F.col("__page") > F.col("from_page")) | (place(w) >= ends("line", "i"))) & ((F.col("__page") < F.col("end_page")) | (place(w) <= ends("end_line", "end_i")))
    w = rows.select("passage", "end_page", "__page", T.once(F.filter("words", within)).alias("w")).select("passage", "end_page", "__page", F.posexplode("w").alias("k", "w"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__page", "k", "w.text"))), lambda x: x["text"]), " ")
    return w.groupBy("passage", "end_page").agg(listed.alias("text"), span_state(F.col("w.state") == "reviewed").alias("state"), F.count("*").alias("words"))


def uncertain_words(index: DataFrame) -> DataFrame:
    """``page, kind, at, text, before, after, nth, total``: doubtful words with what stands around them, numbered by page and kind."""
    part = lambda a, n: F.array_join(F.transform(F.slice("words", a, n), lambda x: x["text"]), " ")
    around = lambda at: F.struct(at.alias("at"), F.get("words", at)["text"].alias("text"), part(F.greatest(at - AROUND, F.lit(0)) + 1, F.least(at, F.lit(AROUND))).alias("before"), part(at + 2, F.lit(AROUND)).alias("after"))
    places = F.filter(F.transform("words", lambda w, i: F.when(w["state"] == "doubtful", i)), lambda i: i.isNotNull())
    # Of a page's words only those around go with a doubtful one; its number is its place in the page's list of them.
    listed = index.select("page", "kind", T.once(F.transform(places, around)).alias("x")).select("page", "kind", F.size("x").cast("long").alias("total"), F.posexplode("x").alias("n", "x"))
    return listed.select("page", "kind", "x.at", "x.text", "x.before", "x.after", (F.col("n") + 1).alias("nth"), "total")
