"""Spelling variants of a corpus's words, found on tries of letter-group counts.

Letters are dealt to twelve groups; three groups make a class.  A word is the vector of its group counts.  One edit
moves a vector by one more in one group, one less in one, or both, so near words lie where a depth-first search ends
that follows the counts and may spend one surplus and one deficit.  The four class counts are the first levels: words
that agree in them share a trie, and a word visits its own trie and those one surplus or deficit away.  A trie of many
words is cut into parts, and so are the words that visit it, so neither grows in a task with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter, ne

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import small_side
from .common import materialize, remove, unsigned

#: Letters of words (both cases; only A-Z is lower-cased).  Fixed values.
LETTERS, UPPER, LOWER = "A-Za-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups and classes of letters; levels of a trie within its class counts (the last group of a class is what is left).
GROUPS, CLASSES = 12, 4
LEVELS = GROUPS - CLASSES
#: Words of a leaf that is not split further, of a part of a trie, and of a block of words that visit it from one trie.
LEAF, PART, BLOCK = 4, 50_000, 4_000


def words(docs: DataFrame, least: int = 7, every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: runs of letters of ``least`` code points or more that occur twice or more.

    A run whose hash (crc32 of ``id:run``) ``every`` divides loses one code point before it is counted: known variants.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{least},}}"), 0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    found = found.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    found = found.select("run", unsigned(F.concat("id", F.lit(":"), "run")).alias("h"), F.length("run").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    short = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.col("size")))
    word = F.when(F.col("h") % every == 0, short).otherwise(F.col("run"))
    return found.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")


def letter_groups(vocabulary: DataFrame) -> dict[str, int]:
    """Group by letter, dealt to and fro in the order of frequency.  At most as many rows as the class has letters (90)."""
    n = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    order = [r["c"] for r in sorted(n, key=lambda r: (-r["count"], r["c"]))]
    return {c: k % GROUPS if k // GROUPS % 2 == 0 else GROUPS - 1 - k % GROUPS for k, c in enumerate(order)}


def vector(word: str, group: dict[str, int]) -> list[int]:
    out = [0] * GROUPS
    for c in word:
        out[group[c]] += 1
    return out


def build(entries: list[tuple], level: int = 0):
    """Trie of entries ``(vector, word, n)``: a dictionary by count for each level, or a list of few entries."""
    if len(entries) <= LEAF or level == LEVELS:
        return entries
    parts: dict[int, list[tuple]] = {}
    for e in entries:
        parts.setdefault(e[0][level], []).append(e)
    return {count: build(own, level + 1) for count, own in parts.items()}


def search(trie, vec: list[int], plus: int, minus: int) -> list[tuple]:
    """Entries at the leaves that one surplus in class ``plus`` and one deficit in class ``minus`` reach.

    -1: in no class; ``CLASSES``: in any class.
    """
    out, stack = [], [(trie, 0, plus, minus)]
    while stack:
        node, level, up, down = stack.pop()
        if type(node) is list:
            out += node
            continue
        v, own = vec[level], level % CLASSES
        level += 1
        if (child := node.get(v)) is not None:
            stack.append((child, level, up, down))
        if (up == own or up == CLASSES) and (child := node.get(v + 1)) is not None:
            stack.append((child, level, -1, down))
        if (down == own or down == CLASSES) and (child := node.get(v - 1)) is not None:
            stack.append((child, level, up, -1))
    return out


def near(a: str, b: str) -> bool:
    """One code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) != 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :]


def _visits(c: list[Column]) -> Column:
    """Tries that a word visits, so that each pair meets once: the word's own, those of words with one letter more, and
    those of words of its length with one letter more in an earlier class and one less in a later one."""
    moves = [(CLASSES, CLASSES), *((i, -1) for i in range(CLASSES)), *((i, j) for i in range(CLASSES) for j in range(i + 1, CLASSES))]
    at = lambda i, j: F.concat_ws(",", *[(c[k] + int(k == i) - int(k == j)).cast("string") for k in range(CLASSES)])
    return F.array(*[F.struct(at(i, j).alias("key"), F.lit(i).cast("byte").alias("plus"), F.lit(j).cast("byte").alias("minus")) for i, j in moves])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, near, near_n``: every pair of words of the table ``word, n`` at one edit, in both directions."""
    group = letter_groups(vocabulary)
    of = lambda k: "".join(c for c in sorted(group) if group[c] % CLASSES == k)
    c = [F.col(f"c{k}") for k in range(CLASSES)]
    counted = vocabulary.select("word", "n", *[(F.length("word") - F.length(F.translate("word", of(k), ""))).alias(f"c{k}") for k in range(CLASSES)])
    own = counted.select("word", "n", F.concat_ws(",", *[x.cast("string") for x in c]).alias("key"))
    sizes = own.groupBy("key").count()
    sizes = small_side(sizes.select("key", F.ceil(F.col("count") / PART).cast("int").alias("parts"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    salt = lambda seed, n: F.pmod(F.xxhash64("word", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    entries = own.join(sizes, "key").select("key", salt(1, "parts").alias("part"), each("blocks").alias("block"), F.lit(False).alias("visits"), "word", "n", F.lit(-1).cast("byte").alias("plus"), F.lit(-1).cast("byte").alias("minus"))
    visits = counted.select("word", "n", F.inline(_visits(c))).join(sizes, "key").select("key", each("parts").alias("part"), salt(2, "blocks").alias("block"), F.lit(True).alias("visits"), "word", "n", "plus", "minus")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entries, trie = None, [], None
        for batch in batches:
            out: list[tuple] = []
            rows = zip(*[x.to_pylist() for x in batch.columns])
            for place, own in groupby(rows, key=itemgetter(0, 1, 2)):
                if place != now:
                    now, entries, trie = place, [], None
                for _, _, _, visiting, word, n, plus, minus in own:
                    vec = vector(word, group)
                    if not visiting:
                        entries.append((vec, word, n))
                        continue
                    if trie is None:
                        trie, entries = build(entries), []
                    head, tail = word[:3], word[-3:]
                    for _, other, m in search(trie, vec, plus, minus):
                        # One edit leaves the first or the last letters of a word alone.
                        if (other.startswith(head) or other.endswith(tail)) and (plus != CLASSES or word < other) and near(word, other):
                            out += [(word, other, m), (other, word, n)]
                if len(out) > 50_000:
                    yield _pairs(out)
                    out = []
            yield _pairs(out)

    # A visit costs far more than its bytes tell, so tasks are counted by rows, not left to sizes of files.
    tasks = max(4 * vocabulary.sparkSession.sparkContext.defaultParallelism, vocabulary.count() // 20_000)
    together = entries.unionByName(visits).repartition(tasks, "key", "part", "block").sortWithinPartitions("key", "part", "block", "visits")
    return together.mapInArrow(work, "word string, near string, near_n long")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], ["word", "near", "near_n"])


def forms(vocabulary: DataFrame, times: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n``: a word's form is its most frequent near word, if it is ``times`` as frequent.

    Of equally frequent near words the first in code-point order counts.
    """
    own = vocabulary.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    links = near_words(vocabulary).select("word", F.lit(None).cast("long").alias("n"), "near", "near_n")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))).alias("best")
    by = own.unionByName(links).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best)
    holds = -F.col("best.less") >= times * F.col("n")
    return by.select("word", "n", "n_near", F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n"))


def with_roots(table: DataFrame) -> DataFrame:
    """``root`` of each word: its form's form and so on to the last.  A form is more frequent, so there are no rings.

    Each round doubles the steps taken, so there are as many rounds as the longest chain has binary digits.
    """
    links = materialize(table.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not links.where("moved").isEmpty():
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        farther = links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, links = links, materialize(farther, "forms")
        remove(before)
    return table.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of seven letters or more that occurs twice or more.

    Null and empty texts have no words; a row without an id is hashed with an empty one; each of repeated rows counts;
    very long runs are words like any other; an empty table gives an empty result; other columns are not read.
    """
    vocabulary = materialize(words(docs, id_col=id_col, text_col=text_col), "vocabulary")
    table = materialize(forms(vocabulary), "variants")
    remove(vocabulary)
    return with_roots(table).select("word", "form", "root", "n", "n_near", "form_n")
