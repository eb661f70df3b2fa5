"""Book analytics: printed page numbers, page sequences, running heads, neighbours, line measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import components

REACH = 10


def offset_votes(pages: DataFrame) -> DataFrame:
    """``book, number, offset, votes``: offsets of the numbered pages within ``REACH`` pages, the page itself left out.

    The band join is an equi-join on ranges of pages, each page being sent to the ranges it touches.
    """
    wide = F.floor(F.col("number") / REACH)
    voters = pages.where("printed IS NOT NULL").select(F.col("book").alias("b"), F.col("number").alias("m"), (F.col("printed") - F.col("number")).alias("offset"))
    voters = voters.select("*", F.explode(F.sequence(F.floor((F.col("m") - REACH) / REACH), F.floor((F.col("m") + REACH) / REACH))).alias("r"))
    near = pages.select("book", "number", wide.alias("range")).join(voters, (F.col("book") == F.col("b")) & (F.col("range") == F.col("r")) & (F.abs(F.col("m") - F.col("number")) <= REACH) & (F.col("m") != F.col("number")))
    return near.groupBy("book", "number", "offset").agg(F.count("*").alias("votes"))


def printed_pages(pages: DataFrame) -> DataFrame:
    """``book, number, printed, shown, source``: a page's own reading, an inferred number, or none.

    The own reading stands if two neighbours share its offset; else an offset with two votes and more than half of
    all is taken, if it gives a positive number.
    """
    votes = offset_votes(pages).groupBy("book", "number").agg(F.sum("votes").alias("total"), F.max_by("offset", "votes").alias("top"), F.max("votes").alias("most"), F.map_from_entries(F.collect_list(F.struct("offset", "votes"))).alias("by"))
    out = pages.join(votes, ["book", "number"], "left")
    own = F.coalesce(F.element_at("by", F.col("printed") - F.col("number")), F.lit(0)) >= 2
    inferred = (F.col("most") >= 2) & (2 * F.col("most") > F.col("total")) & (F.col("number") + F.col("top") > 0)
    source = F.when(F.col("printed").isNotNull() & own, "page").when(inferred, "inferred").otherwise("none")
    shown = F.when(source == "page", F.col("printed")).when(source == "inferred", F.col("number") + F.col("top"))
    return out.select("book", "number", "printed", shown.alias("shown"), source.alias("source"))


def sequence_anomalies(pages: DataFrame) -> DataFrame:
    """``book, number, label, printed, expected`` of pages whose printed number breaks the sequence.

    A reading follows another if it is larger, by no more than the pages between them.  A reading that neither follows
    the one before nor is followed by the next, while those two follow each other, is uncertain and stepped over; so
    the next one is never a break, and in a run of such readings every second one is stepped over.  Of the others, one
    that does not follow is a duplicate or a gap.  A book needs three readings.
    """
    book = Window.partitionBy("book").orderBy("number")
    placed = pages.select("book", F.col("number").cast("long").alias("number"), F.col("printed").cast("long").alias("printed"), F.row_number().over(book).alias("at"))
    read = placed.where("printed >= 0").withColumn("readings", F.count("*").over(Window.partitionBy("book"))).where("readings >= 3")
    follows = lambda a, b: (a["printed"] < b["printed"]) & (b["printed"] <= a["printed"] + b["at"] - a["at"])
    here = F.struct("number", "printed", "at")
    near = read.select("book", "number", here.alias("own"), F.lag(here).over(book).alias("before"), F.lead(here).over(book).alias("after"), F.row_number().over(book).alias("nth"))
    own, before, after = F.col("own"), F.col("before"), F.col("after")
    near = near.withColumn("odd", F.coalesce(~follows(before, own) & ~follows(own, after) & follows(before, after), F.lit(False)))
    # Places since the last reading that was not odd: 1, 3, 5... are stepped over.
    since = F.col("nth") - F.coalesce(F.max(F.when(~F.col("odd"), F.col("nth"))).over(book.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    near = near.withColumn("skipped", since % 2 == 1).withColumn("after_skip", F.coalesce(F.lag("skipped").over(book), F.lit(False)))
    label = F.when(F.col("skipped"), "uncertain").when(F.col("after_skip") | before.isNull() | follows(before, own), None).when(before["printed"] == own["printed"], "duplicate").otherwise("gap")
    expected = before["printed"] + F.when(F.col("skipped"), own["at"] - before["at"]).otherwise(0)
    return near.select("book", "number", label.alias("label"), own["printed"].alias("printed"), expected.alias("expected")).where("label IS NOT NULL")


def neighbour(pages: DataFrame, step: int) -> DataFrame:
    """``book, number, near``: the next (``step`` 1) or previous (-1) page at a distance of one or two, else null."""
    reach = pages.select("book", "number", F.explode(F.array(F.lit(1), F.lit(2))).alias("d"))
    other = pages.select(F.col("book").alias("b"), F.col("number").alias("near"))
    found = reach.join(other, (F.col("book") == F.col("b")) & (F.col("near") == F.col("number") + step * F.col("d")), "left")
    return found.groupBy("book", "number").agg(F.min_by("near", F.when(F.col("near").isNotNull(), F.col("d"))).alias("near"))


def head_pairs(heads: DataFrame) -> DataFrame:
    """Pairs ``book, a, b`` of different matching keys of ``heads(book, key)``.

    Keys within two edits share one of three pieces, moved by two places at most; pieces are met in an equi-join
    and the match is verified.
    """
    keys = heads.select("book", "key").distinct().where(F.length("key") >= 4)
    n = F.length("key")
    cut = lambda k: F.floor(n * k / 3).cast("int")
    pieces = keys.select("book", "key", n.alias("n"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), cut(k).alias("at"), F.substr("key", cut(k) + 1, cut(k + 1) - cut(k)).alias("piece")) for k in range(3)])).alias("p"))
    own = pieces.select("book", "key", "n", F.col("p.at").alias("at"), F.col("p.piece").alias("piece"))
    size = F.explode(F.array(*[F.struct((n + d).alias("m"), F.lit(k).alias("k")) for d in range(-2, 3) for k in range(3)]))
    asked = keys.select(F.col("book").alias("b2"), F.col("key").alias("other"), size.alias("s")).where("s.m >= 4")
    at, end = F.floor(F.col("s.m") * F.col("s.k") / 3).cast("int"), F.floor(F.col("s.m") * (F.col("s.k") + 1) / 3).cast("int")
    asked = asked.select("b2", "other", F.col("s.m").alias("m"), at.alias("at2"), (end - at).alias("w"), F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("d"))
    asked = asked.where("at2 + d >= 0").select("b2", "other", "m", "at2", F.substr("other", F.col("at2") + F.col("d") + 1, F.col("w")).alias("piece2"))
    met = own.join(asked, (F.col("book") == F.col("b2")) & (F.col("n") == F.col("m")) & (F.col("at") == F.col("at2")) & (F.col("piece") == F.col("piece2")) & (F.col("key") < F.col("other")))
    return met.select("book", F.col("key").alias("a"), F.col("other").alias("b")).distinct().where(T.heads_match(F.col("a"), F.col("b")))


def head_clusters(heads: DataFrame, least: int = 3) -> DataFrame:
    """``book, key, cluster, pages`` of keys whose cluster (matching is transitive) stands on ``least`` pages or more."""
    pairs = head_pairs(heads).select(F.concat_ws("\t", "book", "a").alias("a"), F.concat_ws("\t", "book", "b").alias("b"))
    root = components(pairs, "a", "b")
    counted = heads.groupBy("book", "key").agg(F.count("*").alias("n")).withColumn("id", F.concat_ws("\t", "book", "key"))
    named = counted.join(root, counted.id == root.node, "left").select("book", "key", "n", F.coalesce("component", "id").alias("c"))
    sums = named.groupBy("c").agg(F.sum("n").alias("pages")).where(F.col("pages") >= least)
    return named.join(sums, "c").select("book", "key", F.substring_index("c", "\t", -1).alias("cluster"), "pages")


def islands(rows: DataFrame, keys: list[str], order: str, starts: Column, name: str = "island") -> DataFrame:
    """``rows`` with a running number that grows where ``starts`` holds (gaps and islands, paragraphs, chapters)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def measure(lines: DataFrame, key: str, x0: str, x1: str) -> DataFrame:
    """Medians of both edges over lines at least 60 % as wide as the page's widest."""
    widest = Window.partitionBy(key)
    wide = lines.withColumn("w", F.col(x1) - F.col(x0)).withColumn("top", F.max("w").over(widest)).where(F.col("w") >= 0.6 * F.col("top"))
    return wide.groupBy(key).agg(F.median(x0).alias("left"), F.median(x1).alias("right"))
