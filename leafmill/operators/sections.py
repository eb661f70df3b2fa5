"""Sections of books without headings: a new one at the first block a given number of pages after the last one's start."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, remove


def section_starts(blocks: DataFrame, pages: int = 10) -> DataFrame:
    """``book, block`` of every section's first block, from ``blocks(book, block, page)``.

    The first block of a book begins a section, and counting begins at its first block with a page; blocks without one
    begin none.  Where each block's section would end does not depend on the sections before, so that is worked out for
    all blocks at once: the links to the next start.  The starts are then the blocks that the first one's links reach;
    each round doubles the links' length and so takes all starts at twice the distance, whatever the book's size.
    """
    b = blocks.select("book", F.col("block").cast("long").alias("block"), F.col("page").cast("long").alias("page"))
    # Pages of later blocks can be smaller; what counts is the first block that is far enough, so the highest page so far.
    w = Window.partitionBy("book").orderBy("block")
    paged = b.where("page IS NOT NULL").withColumn("top", F.max("page").over(w))
    tops = paged.groupBy("book", "top").agg(F.min("block").alias("at"))
    # From the highest page downwards the frame only grows; upwards it would be gone through anew for every row.
    far = Window.partitionBy("book").orderBy(F.desc("top")).rangeBetween(Window.unboundedPreceding, -pages)
    links = materialize(paged.where("page = top").join(tops.withColumn("next", F.min("at").over(far)).select("book", "top", "next"), ["book", "top"]).where("next IS NOT NULL").select("book", "block", "next"), "section-links")
    reached = materialize(paged.groupBy("book").agg(F.min("block").alias("block")), "section-starts")
    n = reached.count()
    while True:
        step = reached.join(links, ["book", "block"]).select("book", F.col("next").alias("block"))
        wider = materialize(reached.union(step).distinct(), "section-starts")
        remove(reached)
        reached, before, n = wider, n, wider.count()
        if n == before:
            break
        onward = links.select("book", F.col("block").alias("next"), F.col("next").alias("then"))
        longer = materialize(links.join(onward, ["book", "next"]).select("book", "block", F.col("then").alias("next")), "section-links")
        remove(links)
        links = longer
    first = b.groupBy("book").agg(F.min("block").alias("block"), F.min(F.when(F.col("page").isNotNull(), F.col("block"))).alias("paged"))
    # The block at which counting begins is no start itself, unless it is the first.
    counted = first.where("paged <> block").select("book", F.col("paged").alias("block"))
    return reached.join(counted, ["book", "block"], "left_anti").union(first.select("book", "block")).distinct()
