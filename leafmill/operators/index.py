"""The text index: one row per page and kind with its words in order, and its upkeep by stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import materialize, spread

#: Part of every stamp; a new layout makes all rows stale.
VERSION = "v1"


def index_pages(pages: DataFrame, page: str = "page_id", book: str = "book", text: str = "text", arabic: bool = True) -> DataFrame:
    """``pages`` without the text, with ``norm`` (the words, one space apart), ``norms`` and ``raws``, where there is a word.

    ``raws`` are the words as written, null where they are the normal forms.  Each text is folded once: the explode of
    one value keeps the optimizer from working out the expression again for the filter and for each use.
    """
    cut = pages.select(*[c for c in pages.columns if c != text], F.explode(F.array(T.pieces(F.col(text), arabic))).alias("__pieces"))
    normal = cut.select("*", F.explode(F.array(T.folded(F.col("__pieces")))).alias("norm")).where("norm <> ''")
    written = F.trim(F.regexp_replace("__pieces", "  +", " "))
    return normal.select(*[c for c in pages.columns if c != text], "norm", F.split("norm", " ").alias("norms"), F.when(written != F.col("norm"), F.split(written, " ")).alias("raws"))


#: Indexes written by this application: where each lies.
_WRITTEN: dict[tuple, DataFrame] = {}


def state_of(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a table's files from another: their number, sizes, times and names."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def open_index(pages: DataFrame, path: str, **options) -> DataFrame:
    """The index of ``pages`` (read from ``path``), written once for each state of the files and read by all queries."""
    spark = pages.sparkSession
    key = (spark.sparkContext.applicationId, path, state_of(spark, path), tuple(pages.columns), tuple(sorted(options.items())))
    if key not in _WRITTEN:
        index = materialize(index_pages(spread(pages), **options), "index")
        index.vocabulary = materialize(vocabulary(index), "vocabulary")
        _WRITTEN[key] = index
    return _WRITTEN[key]


def vocabulary(index: DataFrame) -> DataFrame:
    """``word, uses, pages`` of all words of an index: its written table, or worked out."""
    if hasattr(index, "vocabulary"):
        return index.vocabulary
    # A page's words in order: the first of its equals counts the page, so words alone are grouped and combine before the shuffle.
    ordered = index.select(T.once(F.array_sort("norms")).alias("ws"))
    each = F.transform("ws", lambda w, i: F.struct(w.alias("word"), ((i == 0) | (w != F.get("ws", i - 1))).cast("long").alias("first")))
    words = ordered.select(T.once(each).alias("x")).select(F.explode("x").alias("x")).select("x.word", "x.first")
    return words.groupBy("word").agg(F.count("*").alias("uses"), F.sum("first").alias("pages"))


def line_words(lines: DataFrame) -> DataFrame:
    """``page_id, book, kind, own``: the words of each line that has any, without a shuffle; for what counts words one by one.

    ``line(page_id, book, line_id, ord, role, region, reviewed, updated_at, tokens)``.  Running heads and page numbers are left
    out; the words carry their line, place and review state.
    """
    kept = _kept(lines)

    def items(t, i):
        state = T.token_state(t["conf"], t["res"], F.col("reviewed")).alias("state")
        return F.transform(_words(t), lambda w, k: F.struct("ord", i.alias("i"), k.alias("k"), "line_id", w["raw"].alias("text"), w["norm"].alias("norm"), state))

    return kept.select("page_id", "book", "kind", T.once(F.flatten(F.transform("tokens", items))).alias("own")).where(F.size("own") > 0)


def _words(t):
    """Words of a line's token; a call has none."""
    return T.words(F.when(~F.coalesce(t["call"], F.lit(False)), t["t"]))


def pages_with_words(lines: DataFrame) -> DataFrame:
    """``page_id`` of the pages that :func:`index_lines` has a row of; of a line no more is read than its first word."""
    return _kept(lines).where(F.exists("tokens", lambda t: F.size(_words(t)) > 0)).select("page_id").distinct()


def _kept(lines: DataFrame) -> DataFrame:
    """Lines that are indexed, with their ``kind``."""
    notes = (F.col("role") == "footnote") | (F.coalesce("role", F.lit("")).isin("", "body") & (F.col("region") == "footnote"))
    return lines.where(~F.coalesce("region", F.lit("")).isin("running_header", "page_number")).withColumn("kind", F.when(F.coalesce(notes, F.lit(False)), "notes").otherwise("body"))


def index_lines(lines: DataFrame) -> DataFrame:
    """Index rows of reviewed lines (see :func:`line_words`): body and notes get rows of their own, the words in order."""
    # A row a line, not a word: what is shuffled and sorted is a page's lines.
    rows = line_words(lines).groupBy("page_id", "book", "kind").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("words"))
    return rows.withColumns({"norms": F.col("words.norm"), "norm": F.array_join(F.col("words.norm"), " ")})


def stamps(lines: DataFrame) -> DataFrame:
    """``page_id, stamp``: version, lines, reviewed lines and last change in microseconds."""
    return lines.groupBy("page_id").agg(F.concat_ws(":", F.lit(VERSION), F.count("*"), F.count_if("reviewed"), F.coalesce(F.unix_micros(F.max("updated_at").cast("timestamp")), F.lit(0))).alias("stamp"))


def changes(stored: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of two tables of signatures: added, removed, changed, same."""
    s, c = stored.select(F.col(key).alias("k1"), F.col(value).alias("v1")), current.select(F.col(key).alias("k2"), F.col(value).alias("v2"))
    change = F.when(F.col("k1").isNull(), "added").when(F.col("k2").isNull(), "removed").when(F.col("v1").eqNullSafe(F.col("v2")), "same").otherwise("changed")
    return s.join(c, F.col("k1") == F.col("k2"), "full_outer").select(F.coalesce("k1", "k2").alias(key), change.alias("change"), F.col("v1").alias("stored"), F.col("v2").alias("current"))


def refresh(index: DataFrame, stale: DataFrame, fresh: DataFrame, page: str = "page_id") -> DataFrame:
    """The index after an upkeep: rows of stale or vanished pages out, fresh rows in."""
    return index.join(stale.select(page).distinct(), page, "left_anti").unionByName(fresh)
