"""Text queries over documents as pages: a source is a book, a page's number its place in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import text as T
from ..operators import evaluate as E
from ..operators import index as I
from ..operators import library as B
from ..operators import review as W
from ..operators import search as X
from ..operators import verify as V
from .registry import query, read

#: DuckDB: the normal forms of a text's words, from the rules (white space, note marks, separators, letters and digits).
_WS = r"[ \t\n\x0B\f\r\x{00A0}\x{2028}\x{2029}]+"


def _duck_norms(t: str) -> str:
    marks = f"array_to_string(list_filter(regexp_split_to_array(coalesce({t}, ''), '{_WS}'), lambda x: x <> '' AND NOT regexp_matches(x, '{T.MARKER}')), ' ')"
    pieces = rf"string_split(regexp_replace(regexp_replace({marks}, '{T.GLUED}', ' ', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}\p{{Cf}}\x{{0640}}]+', ' ', 'g'), ' ')"
    return rf"list_filter(list_transform({pieces}, lambda p: regexp_replace(p, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda w: w <> '')"


_PAGES = f"p AS (SELECT doc_id, source AS book, doc_id // 20 AS number, text, {_duck_norms('text')} AS ws FROM documents)"
_ITEMS = f"q AS (SELECT item_id AS query, {_duck_norms('text')} AS qs FROM benchmark)"


def _pages(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.col("source").alias("book"), F.floor(F.col("doc_id") / 20).cast("long").alias("number"), "text")


def _index(spark, sf):
    return I.open_index(_pages(spark, sf), f"{sf}/documents.parquet", page="doc_id", arabic=False)


def _items(spark, sf, words=None):
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query"), T.norms(F.col("text"), False).alias("words"))
    return q if words is None else q.where(F.size("words") >= words).select("query", F.slice("words", 1, words).alias("words"))


@query(f"""WITH {_PAGES}, {_ITEMS}, g AS (SELECT doc_id, i - 1 AS start, array_to_string(ws[i : i + 2], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM p))
 SELECT query, doc_id, start FROM g JOIN (SELECT query, array_to_string(qs[1:3], ' ') AS phrase FROM q WHERE len(qs) >= 3) ON gram = phrase""")
def phrase_search(spark, sf):
    """All places of every item's first three words."""
    return X.phrase_hits(_index(spark, sf), _items(spark, sf, 3), "doc_id", 3).select("query", "doc_id", F.col("start").cast("long").alias("start"))


@query(f"""WITH {_PAGES}, w AS (SELECT doc_id, book, number, ws, (SELECT arg_min(b.ws, b.number) FROM p b WHERE b.book = a.book AND b.number IN (a.number + 1, a.number + 2) AND len(b.ws) > 0) AS nx FROM p a WHERE len(ws) > 0),
 j AS (SELECT doc_id, cut, array_to_string(list_concat(ws[len(ws) - cut + 1 :], nx[1 : 3 - cut]), ' ') AS gram FROM w, range(1, 3) AS c(cut) WHERE len(ws) >= cut AND len(nx) >= 3 - cut),
 q AS (SELECT doc_id AS query, array_to_string(list_concat(ws[len(ws) :], nx[1:2]), ' ') AS phrase FROM w WHERE len(nx) >= 2)
 SELECT query, doc_id, cut FROM j JOIN q ON gram = phrase""")
def phrase_search_cross_page(spark, sf):
    """Phrases over a page break: each page's last word with the next page's first two is a query."""
    ix = _index(spark, sf)
    near = B.neighbour(ix, 1).where("near IS NOT NULL")
    heads = ix.select(F.col("book").alias("b"), F.col("number").alias("n"), F.slice("norms", 1, 2).alias("head")).where(F.size("head") == 2)
    q = ix.join(near, ["book", "number"]).join(heads, (F.col("book") == F.col("b")) & (F.col("near") == F.col("n")))
    q = q.select(F.col("doc_id").alias("query"), F.concat(F.slice("norms", -1, 1), F.col("head")).alias("words"))
    return X.across_pages(ix, q, "doc_id", "book", "number", 3).select("query", "doc_id", F.col("cut").cast("long").alias("cut"))


@query(f"""WITH {_PAGES}, {_ITEMS}, n AS (SELECT query, list_distinct(qs[1:4]) AS d FROM q WHERE len(qs) >= 4), t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM p),
 o AS (SELECT query, doc_id, w, i FROM t JOIN (SELECT query, unnest(d) AS w FROM n) USING (w)), c AS (SELECT query, doc_id FROM o JOIN n USING (query) GROUP BY query, doc_id, d HAVING count(DISTINCT w) = len(d)),
 s AS (SELECT a.query, a.doc_id, a.i AS s, b.w, min(b.i) AS e FROM o a JOIN c USING (query, doc_id) JOIN o b ON b.query = a.query AND b.doc_id = a.doc_id AND b.i >= a.i GROUP BY ALL),
 z AS (SELECT s.query, doc_id, s, max(e) + 1 AS e FROM s JOIN n USING (query) GROUP BY s.query, doc_id, s, d HAVING count(*) = len(d))
 SELECT query, doc_id, arg_min(s, (e - s, s)) AS start, arg_min(e, (e - s, s)) AS "end" FROM z GROUP BY query, doc_id""")
def all_words_search(spark, sf):
    """Pages with all of an item's first four words, and the smallest window that covers them."""
    return X.all_words(_index(spark, sf), _items(spark, sf, 4), "doc_id").select("query", "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f"""WITH {_PAGES}, {_ITEMS}, g AS (SELECT doc_id, i - 1 AS s, ws, array_to_string(ws[i : i + 2], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM p)),
 h AS (SELECT query, doc_id, s, ws FROM g JOIN (SELECT query, array_to_string(qs[1:3], ' ') AS phrase FROM q WHERE len(qs) >= 3) ON gram = phrase)
 SELECT query, doc_id, s AS start, CASE WHEN s > 12 THEN '… ' ELSE '' END || array_to_string(ws[greatest(s - 12, 0) + 1 : s], ' ') AS before, array_to_string(ws[s + 1 : s + 3], ' ') AS match, array_to_string(ws[s + 4 : s + 15], ' ') || CASE WHEN len(ws) > s + 15 THEN ' …' ELSE '' END AS after FROM h""")
def kwic_context(spark, sf):
    """Hits with twelve words before and after; words are fetched for the hits only."""
    hits = X.phrase_places(_index(spark, sf), _items(spark, sf, 3), "doc_id", 3)
    return hits.select("query", "doc_id", F.col("start").cast("long").alias("start"), X.context(F.col("norms"), F.col("start"), F.col("start") + 3).alias("c")).select("query", "doc_id", "start", "c.*")


@query(f"""WITH {_PAGES} SELECT doc_id, book, len(ws) AS n_words, md5(array_to_string(ws, ' ')) AS norm_md5, len(list_distinct(ws)) AS n_distinct FROM p WHERE len(ws) > 0""")
def token_index(spark, sf):
    """The index of all pages: normal text (by digest) and word counts."""
    return _index(spark, sf).select("doc_id", "book", F.size("norms").cast("long").alias("n_words"), F.md5(F.col("norm").cast("binary")).alias("norm_md5"), F.size(F.array_distinct("norms")).cast("long").alias("n_distinct"))


@query(f"""WITH {_PAGES}, t AS (SELECT book, unnest(ws) AS w FROM p) SELECT w AS word, count(*) AS n, count(DISTINCT book) AS books FROM t GROUP BY w ORDER BY n DESC, word LIMIT 100""")
def vocab_top(spark, sf):
    """The hundred most frequent words (a report)."""
    t = _index(spark, sf).select("book", F.explode("norms").alias("word")).groupBy("word", "book").agg(F.count("*").alias("k"))
    return t.groupBy("word").agg(F.sum("k").alias("n"), F.count("*").alias("books")).orderBy(F.desc("n"), "word").limit(100)


@query(f"""WITH {_PAGES}, {_ITEMS}, t AS (SELECT DISTINCT doc_id, unnest(ws) AS w FROM p), a AS (SELECT query, doc_id, count(*) AS overlap FROM t JOIN (SELECT DISTINCT query, unnest(qs) AS w FROM q) USING (w) GROUP BY ALL),
 l AS (SELECT query, list_sort(list_transform(list_distinct(qs), lambda w: struct_pack(l := -length(w), w := w)))[1:6] AS longest FROM q),
 o AS (SELECT query, doc_id, overlap FROM a JOIN l USING (query) JOIN (SELECT doc_id, array_to_string(ws, ' ') AS norm FROM p) USING (doc_id) WHERE len(list_filter(longest, lambda x: contains(norm, x.w))) > 0)
 SELECT query, doc_id, overlap, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY overlap DESC, doc_id) AS r FROM o) WHERE r <= 32""")
def prefilter_overlap_topk(spark, sf):
    """The 32 pages that share most distinct words with each item, of those that contain one of its six longest words."""
    o = X.overlaps(_index(spark, sf), _items(spark, sf), "doc_id", prefilter=True, first=32)
    return o.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("overlap"), "doc_id"))).where("rank <= 32")


@query(f"""WITH {_PAGES}, {_ITEMS}, n AS (SELECT doc_id, text, ' ' || array_to_string(ws, ' ') || ' ' AS norm FROM p), b AS (SELECT query, text AS raw, ' ' || array_to_string(qs, ' ') || ' ' AS qn FROM q JOIN benchmark ON item_id = query)
 SELECT query, doc_id, contains(n.text, raw) AS raw FROM n JOIN b ON qn <> '  ' AND contains(norm, qn)""")
def substring_baseline(spark, sf):
    """Pages that hold an item's normal text, and whether the raw text stands there too.

    Runs of three words (or of as many as a shorter item has) find the pages; the substring test runs on those alone.
    """
    ix = _index(spark, sf)
    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("raw_text"), T.norms(F.col("text"), False).alias("qs")).where(F.size("qs") > 0)
    short = lambda k: items.where(F.least(F.size("qs"), F.lit(3)) == k).select("query", F.slice("qs", 1, k).alias("words"))
    hits = reduce(DataFrame.union, [X.phrase_places(ix, short(k), "doc_id", k).select("query", "doc_id", "norms") for k in (1, 2, 3)]).dropDuplicates(["query", "doc_id"])
    found = hits.join(items, "query").where(F.contains(F.concat(F.lit(" "), F.array_join("norms", " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join("qs", " "), F.lit(" "))))
    texts = read(spark, sf, "documents").select("doc_id", "text")
    return found.select("query", "doc_id", "raw_text").join(texts, "doc_id").select("query", "doc_id", F.contains("text", "raw_text").alias("raw"))


def _duck_markup() -> str:
    # Texts and tags in turn; each tag is what it stands for, and all are joined.
    texts, tags = "regexp_split_to_array(html, '<[^>]+>')", "regexp_extract_all(html, '<[^>]+>')"
    stands = f"CASE WHEN regexp_matches({tags}[i], '{T._LINE_END}') THEN chr(10) WHEN regexp_matches({tags}[i], '{T._CELL_END}') THEN ' ' ELSE '' END"
    t = f"array_to_string(list_transform(range(1, len({texts}) + 1), lambda i: {texts}[i] || {stands}), '')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", chr(0xA0)), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        t = f"replace({t}, '&{name};', '{char}')"
    lines = rf"array_to_string(list_transform(string_split({t}, chr(10)), lambda s: regexp_replace(s, '^(?:\s{{0,3}}#{{1,6}}\s*)?(?:\s*[-:| ]{{3,}}\s*$|\s*[-*•](?:\s+|$))?', '')), chr(10))"
    t = rf"regexp_replace(replace(regexp_replace({lines}, '\*\*|__|`+', '', 'g'), '|', ' '), '[ \t\x{{00A0}}\x{{200F}}\x{{200E}}\x{{202A}}-\x{{202E}}]+', ' ', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda s: trim(s)), lambda s: s <> ''), chr(10))"


@query(f"""SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT page_id, {_duck_markup()} AS t FROM pages)""")
def markup_strip(spark, sf):
    """Plain lines of web pages."""
    return read(spark, sf, "pages").select("page_id", T.strip_markup(F.col("html")).alias("t")).select("page_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query(f"""WITH {_PAGES}, t AS (SELECT doc_id, book, number, unnest(ws) AS w FROM p), c AS (SELECT doc_id, book, number, w, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT doc_id, book, number, len(ws) AS size FROM p WHERE len(ws) > 0),
 x AS (SELECT a.doc_id, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.book = b.book AND b.number = a.number + 1 AND a.w = b.w GROUP BY 1)
 SELECT a.doc_id, round(2.0 * coalesce(common, 0) / (a.size + b.size), 6) AS f1 FROM s a JOIN s b ON a.book = b.book AND b.number = a.number + 1 LEFT JOIN x ON x.doc_id = a.doc_id""")
def word_f1_pairs(spark, sf):
    """Word F1 of each page with the next: a multiset intersection."""
    ix = _index(spark, sf)
    # A page's words meet the next page's as one row, not a row a word; a page's key is that of the pair.
    side = lambda back, text: ix.select("doc_id", "book", (F.col("number") - back).alias("number"), "norm").repartition("book", "number").groupBy("doc_id", "book", "number").agg(F.array_join(F.collect_list("norm"), " ").alias(text))
    met = side(0, "a").join(side(1, "b").drop("doc_id"), ["book", "number"]).select("doc_id", "a", "b")
    common = met.mapInArrow(W.shared_words, "doc_id long, n long").groupBy("doc_id").agg(F.sum("n").alias("common"))
    s = ix.select("doc_id", "book", "number", F.size("norms").alias("size"))
    pairs = s.join(s.select("book", (F.col("number") - 1).alias("number"), F.col("size").alias("other")), ["book", "number"]).join(common, "doc_id", "left")
    return pairs.select("doc_id", F.round(2.0 * F.coalesce("common", F.lit(0)) / (F.col("size") + F.col("other")), 6).alias("f1"))


@query("""WITH t AS (SELECT item_id, regexp_replace(text, '[^ -~]', '?', 'g') AS text FROM benchmark) SELECT a.item_id, levenshtein(a.text, b.text) AS edits, round(levenshtein(a.text, b.text) / length(b.text), 6) AS cer FROM t a JOIN t b ON b.item_id = a.item_id + 1 WHERE length(b.text) > 0""")
def cer_pairs(spark, sf):
    """Character error rate of neighbouring items."""
    a = read(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "?").alias("text"))  # DuckDB counts bytes
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("ref")).where(F.length("ref") > 0)
    d = F.levenshtein("text", "ref")
    return a.join(b, "item_id").select("item_id", d.cast("long").alias("edits"), F.round(d / F.length("ref"), 6).alias("cer"))


_HEADS = rf"h AS (SELECT source AS book, regexp_replace(lower(regexp_replace(string_split(text, chr(10))[1], '[^\p{{L}}\p{{N}}\p{{M}}_]+', ' ', 'g')), '[ 0-9]', '', 'g') AS key FROM documents WHERE len(list_filter(regexp_split_to_array(string_split(text, chr(10))[1], '\s+'), lambda x: x <> '')) BETWEEN 1 AND 6)"
#: DuckDB's distance counts bytes, so letters beyond ASCII stand as capitals, which keys do not have.
_ONE = "translate({}, 'äöüßáàâéèêëíîïñóôúùûçœ¿¡ªº', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_MATCH = f"(a.key = b.key OR (least(length(a.key), length(b.key)) >= 4 AND levenshtein({_ONE.format('a.key')}, {_ONE.format('b.key')}) <= CASE WHEN greatest(length(a.key), length(b.key)) >= 12 THEN 2 ELSE 1 END))"


def _heads(spark, sf):
    first = F.get(F.split("text", "\n"), F.lit(0))
    return read(spark, sf, "documents").where(T.word_count(first).between(1, 6)).select(F.col("source").alias("book"), T.head_key(first).alias("key"))


@query(f"""WITH {_HEADS}, d AS (SELECT DISTINCT book, key FROM h WHERE length(key) >= 4) SELECT a.book, a.key AS a, b.key AS b FROM d a JOIN d b ON a.book = b.book AND a.key < b.key WHERE {_MATCH}""")
def near_equal_keys(spark, sf):
    """Pairs of running-head keys within an edit or two, by shared pieces."""
    return B.head_pairs(_heads(spark, sf))


@query(f"""WITH RECURSIVE {_HEADS}, c AS (SELECT book, key, count(*) AS n FROM h GROUP BY ALL), e AS (SELECT a.book, a.key AS x, b.key AS y FROM c a JOIN c b ON a.book = b.book AND a.key <> b.key WHERE least(length(a.key), length(b.key)) >= 4 AND {_MATCH}),
 r AS (SELECT book, key, key AS y FROM c UNION SELECT r.book, r.key, e.y FROM r JOIN e ON e.book = r.book AND e.x = r.y), m AS (SELECT book, key, min(y) AS cluster FROM r GROUP BY ALL), s AS (SELECT m.book, cluster, CAST(sum(n) AS BIGINT) AS pages FROM m JOIN c USING (book, key) GROUP BY ALL HAVING sum(n) >= 3)
 SELECT m.book, m.key, m.cluster, pages FROM m JOIN s ON s.book = m.book AND s.cluster = m.cluster""")
def head_clusters(spark, sf):
    """Running heads: transitive clusters of matching keys on three pages or more."""
    return B.head_clusters(_heads(spark, sf))


_NUMBERED = "n AS (SELECT source AS book, doc_id // 20 AS number, CASE WHEN n_chars % 5 = 0 THEN NULL WHEN n_chars % 7 = 0 THEN 3 ELSE doc_id // 20 + 10 END AS printed FROM documents)"


def _numbered(spark, sf):
    p = read(spark, sf, "documents").select(F.col("source").alias("book"), F.floor(F.col("doc_id") / 20).cast("long").alias("number"), "n_chars")
    printed = F.when(F.col("n_chars") % 5 == 0, None).when(F.col("n_chars") % 7 == 0, 3).otherwise(F.col("number") + 10)
    return p.select("book", "number", printed.cast("long").alias("printed"))


@query(f"""WITH {_NUMBERED} SELECT a.book, a.number, b.printed - b.number AS "offset", count(*) AS votes FROM n a JOIN n b ON a.book = b.book AND b.number BETWEEN a.number - 10 AND a.number + 10 AND b.number <> a.number WHERE b.printed IS NOT NULL GROUP BY ALL""")
def offset_votes(spark, sf):
    """Votes of the pages around for the printed numbers' offset (readings derived from the texts' lengths)."""
    return B.offset_votes(_numbered(spark, sf))


@query(f"""WITH {_NUMBERED}, v AS (SELECT a.book, a.number, b.printed - b.number AS o, count(*) AS c FROM n a JOIN n b ON a.book = b.book AND b.number BETWEEN a.number - 10 AND a.number + 10 AND b.number <> a.number WHERE b.printed IS NOT NULL GROUP BY ALL),
 t AS (SELECT book, number, sum(c) AS total, max(c) AS most, arg_max(o, c) AS top FROM v GROUP BY ALL), s AS (SELECT n.*, t.*, coalesce((SELECT c FROM v WHERE v.book = n.book AND v.number = n.number AND v.o = n.printed - n.number), 0) AS own FROM n LEFT JOIN t ON t.book = n.book AND t.number = n.number)
 SELECT book, number, printed, CASE WHEN printed IS NOT NULL AND own >= 2 THEN printed WHEN most >= 2 AND 2 * most > total AND number + top > 0 THEN number + top END AS shown, CASE WHEN printed IS NOT NULL AND own >= 2 THEN 'page' WHEN most >= 2 AND 2 * most > total AND number + top > 0 THEN 'inferred' ELSE 'none' END AS source FROM s""".replace("n.*, t.*", "n.book, n.number, n.printed, total, most, top"))
def printed_page_inference(spark, sf):
    """Printed page numbers, read or inferred."""
    return B.printed_pages(_numbered(spark, sf))


@query(f"""WITH {_NUMBERED}, o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY number) AS pos FROM n), r AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY book) AS k FROM o WHERE printed >= 0) WHERE k >= 3),
 l AS (SELECT book, number, printed, pos, lag(printed) OVER w AS p, lag(pos) OVER w AS pa, lead(printed) OVER w AS f, lead(pos) OVER w AS fa, row_number() OVER w AS nth FROM r WINDOW w AS (PARTITION BY book ORDER BY number)),
 c AS (SELECT *, coalesce(NOT (p < printed AND printed <= p + pos - pa) AND NOT (printed < f AND f <= printed + fa - pos) AND p < f AND f <= p + fa - pa, false) AS odd FROM l),
 s AS (SELECT *, (nth - coalesce(max(CASE WHEN NOT odd THEN nth END) OVER (PARTITION BY book ORDER BY number), 0)) % 2 = 1 AS skipped FROM c), b AS (SELECT *, coalesce(lag(skipped) OVER (PARTITION BY book ORDER BY number), false) AS after FROM s)
 SELECT book, number, CASE WHEN skipped THEN 'uncertain' WHEN p = printed THEN 'duplicate' ELSE 'gap' END AS label, printed, p + CASE WHEN skipped THEN pos - pa ELSE 0 END AS expected FROM b WHERE skipped OR (NOT after AND NOT (p < printed AND printed <= p + pos - pa))""")
def sequence_anomalies(spark, sf):
    """Breaks in the printed numbers, with uncertain readings stepped over."""
    return B.sequence_anomalies(_numbered(spark, sf))


@query("""WITH p AS (SELECT doc_id, source AS book, doc_id // 20 AS number FROM documents WHERE n_chars % 3 > 0) SELECT book, number, (SELECT min(number) FROM p b WHERE b.book = a.book AND b.number BETWEEN a.number + 1 AND a.number + 2) AS near FROM p a""")
def neighbour_join(spark, sf):
    """The next page at a distance of two at most (pages of some lengths count as excluded)."""
    return B.neighbour(_pages(spark, sf).join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").where("n_chars % 3 > 0"), 1)


@query(r"""WITH l AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS pt FROM conversations)
 SELECT conv_id, turn, CASE WHEN prev IS NULL THEN 'first' WHEN turn - pt > 1 THEN 'missing' WHEN regexp_matches(rtrim(prev), '[.؟!:»)\]?”]$') THEN 'separate' ELSE 'join' END AS decision FROM l""")
def seam_decision(spark, sf):
    """Whether a block goes on from the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    prev, pt = F.lag("text").over(w), F.lag("turn").over(w)
    decision = F.when(prev.isNull(), "first").when(F.col("turn") - pt > 1, "missing").when(T.ends_terminal(prev), "separate").otherwise("join")
    return read(spark, sf, "conversations").select("conv_id", "turn", decision.alias("decision"))


@query("""WITH f AS (SELECT quality = 0 AS bad, regexp_matches(text, '[#*$%&|<>]') AS flag, source FROM documents JOIN labels USING (doc_id)), s AS (SELECT source, count(*) AS n, count(*) FILTER (flag) AS flags, count(*) FILTER (bad) AS errors, count(*) FILTER (flag AND bad) AS hits FROM f GROUP BY 1)
 SELECT source, n, flags, errors, hits, round(hits / nullif(flags, 0), 6) AS "precision", round(hits / nullif(errors, 0), 6) AS recall, errors > 0 AND flags = 0 AS missed FROM s""")
def precision_recall(spark, sf):
    """Precision and recall of a flag against labels, per book."""
    d = read(spark, sf, "documents").select("doc_id", "source", F.col("text").rlike("[#*$%&|<>]").alias("flag")).join(read(spark, sf, "labels"), "doc_id")
    bad = F.col("quality") == 0
    s = d.groupBy("source").agg(F.count("*").alias("n"), F.count_if("flag").alias("flags"), F.count_if(bad).alias("errors"), F.count_if(F.col("flag") & bad).alias("hits"))
    return s.select("*", F.round(F.try_divide("hits", "flags"), 6).alias("precision"), F.round(F.try_divide("hits", "errors"), 6).alias("recall"), ((F.col("errors") > 0) & (F.col("flags") == 0)).alias("missed"))


@query()
def verify_benchmark(spark, sf):
    """Every item checked as a quotation of the pages."""
    return V.verify(_index(spark, sf), _items(spark, sf), "doc_id").withColumn("changes", F.to_json("changes"))


@query()
def search_modes(spark, sf):
    """Ranked search in all three modes for every item's first five words, ten hits each."""
    return X.search(_index(spark, sf), _items(spark, sf, 5), "doc_id")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), m AS (SELECT doc_id, i, regexp_extract(line, '^\s*[(\[{«]?\s*([0-9]{1,3}|\*{1,3})\s*[)\]}»]?[-–—ـ.:،]?(?:\s|$)', 1) AS k FROM l)
 SELECT doc_id, i AS line_no, CASE WHEN regexp_matches(k, '^[0-9]') THEN CAST(CAST(k AS INT) AS VARCHAR) ELSE k END AS key FROM m WHERE k <> ''""")
def note_markers(spark, sf):
    """Lines that begin with a note marker, and its comparable key."""
    l = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return l.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.marker_key(F.col("line")).alias("key")).where("key IS NOT NULL")


@query(r"""SELECT doc_id, (length(text) - length(regexp_replace(text, '[,;:]', '', 'g'))) AS n, md5(regexp_replace(text, '[,;:]', '·', 'g')) AS replaced_md5 FROM documents WHERE regexp_matches(text, '[,;:]')""")
def find_replace(spark, sf):
    """Counts and results of a replacement in all texts that hold the pattern."""
    d = read(spark, sf, "documents").where(F.col("text").rlike("[,;:]"))
    return d.select("doc_id", F.regexp_count("text", F.lit("[,;:]")).cast("long").alias("n"), F.md5(F.regexp_replace("text", "[,;:]", "·").cast("binary")).alias("replaced_md5"))


@query(f"""WITH {_PAGES}, t AS (SELECT unnest(ws) AS w FROM p), v AS (SELECT w, length(w) AS l, count(*) AS n FROM t GROUP BY w HAVING count(*) >= 3 AND length(w) >= 2) SELECT l AS length, count(*) AS words, CAST(sum(n) AS BIGINT) AS uses, min(w) AS first FROM v GROUP BY l""")
def length_buckets(spark, sf):
    """Vocabulary by word length: words used three times or more."""
    v = I.vocabulary(_index(spark, sf)).select(F.col("word").alias("w"), F.col("uses").alias("n")).where((F.col("n") >= 3) & (F.length("w") >= 2))
    return v.groupBy(F.length("w").cast("long").alias("length")).agg(F.count("*").alias("words"), F.sum("n").alias("uses"), F.min("w").alias("first"))


@query(f"""WITH {_PAGES}, t AS (SELECT unnest(ws) AS w FROM p), c AS (SELECT lower(w) AS k, w, count(*) AS n FROM t GROUP BY ALL) SELECT k AS norm, arg_max(w, (n, -ord)) AS form, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY w COLLATE "C") AS ord FROM c) GROUP BY k""".replace(' COLLATE "C"', ""))
def printed_form(spark, sf):
    """The most used written form of each word; ties go to the first in byte order."""
    c = I.vocabulary(_index(spark, sf)).select(F.lower("word").alias("k"), F.col("word").alias("w"), F.col("uses").alias("n"))
    return c.groupBy(F.col("k").alias("norm")).agg(F.min_by("w", F.struct(-F.col("n"), "w")).alias("form"), F.sum("n").alias("n"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (regexp_matches(rtrim(s), '[.؟!:»)\]?”]$')) AS closed, count(*) FILTER (len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) <= 6) AS headings, CAST(sum(len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> ''))) AS BIGINT) AS words FROM l GROUP BY doc_id""")
def document_stats(spark, sf):
    """Paragraphs, closed ones, short ones and words of each document; in-row, without a shuffle."""
    s = F.split("text", "\n")
    return read(spark, sf, "documents").where("text IS NOT NULL").select(
        "doc_id", F.size(s).cast("long").alias("paragraphs"), F.size(F.filter(s, lambda x: T.ends_terminal(x))).cast("long").alias("closed"),
        F.size(F.filter(s, lambda x: T.word_count(x) <= 6)).cast("long").alias("headings"), F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + T.word_count(x)).alias("words"),
    )


@query("""SELECT doc_id, doc_id || ':' || n_chars || ':b:1.0-' || CASE WHEN n_chars % 2 = 0 THEN '' ELSE (n_chars + 1) || ':' END || '2.3' AS passage, n_chars + n_chars % 2 AS end_page FROM documents""")
def passage_ids(spark, sf):
    """Passage ids written and parsed again."""
    n = F.col("n_chars")
    made = T.passage_id(F.col("doc_id"), n, F.lit("b"), F.lit(1), F.lit(0), n + n % 2, F.lit(2), F.lit(3))
    return read(spark, sf, "documents").select("doc_id", made.alias("passage")).select("doc_id", "passage", T.parse_passage_id(F.col("passage"))["end_page"].alias("end_page"))


@query("""SELECT c_custkey, c_name || '، ' || c_mktsegment || CASE WHEN c_nationkey % 2 = 0 THEN '، ط ' || c_nationkey ELSE '' END || '، ص ' || c_custkey AS citation, CASE WHEN c_custkey = 1 THEN 'one' WHEN c_custkey = 2 THEN 'two' WHEN c_custkey % 100 BETWEEN 3 AND 10 THEN c_custkey || ' few' ELSE c_custkey || ' many' END AS counted FROM customer""")
def citations(spark, sf):
    """Citations with the empty parts left out, and counted nouns."""
    edition = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(F.lit(" "))
    empty = F.lit("")
    parts = {"author": F.col("c_name"), "title": F.col("c_mktsegment"), "editor": empty, "publisher": empty, "edition": edition, "year": empty, "volume": empty}
    text = T.citation(parts, F.col("c_custkey").cast("string"), F.lit("0"), F.lit(False))
    return read(spark, sf, "customer").select("c_custkey", text.alias("citation"), T.number_form(F.col("c_custkey"), "one", "two", "few", "many").alias("counted"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), a AS (SELECT event_id, ts, CAST(floor((epoch_us(now) - epoch_us(ts)) / 1000000) AS BIGINT) AS s FROM events, n)
 SELECT event_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || ' min' WHEN s < 86400 THEN (s // 3600) || ' h' WHEN s < 2592000 THEN (s // 86400) || ' d' ELSE strftime(ts, '%Y-%m-%d') END AS age, left(sha256(CAST(event_id AS VARCHAR)), 12) AS key FROM a""")
def relative_times(spark, sf):
    """Ages in their largest unit, and hashed keys."""
    e = read(spark, sf, "events")
    now = e.agg(F.max("ts")).scalar()
    return e.select("event_id", T.relative_time(F.col("ts"), now).alias("age"), F.substring(F.sha2(F.col("event_id").cast("string").cast("binary"), 256), 1, 12).alias("key"))


@query()
def repetition_cut(spark, sf):
    """Texts with a repeating tail cut, and how much went; those of even length count as having run into a limit."""
    return read(spark, sf, "documents").select("doc_id", F.length("text").alias("before"), F.length(S.truncate_repetition("text", F.length("text") % 2 == 0)).alias("after")).where("after < before")


@query()
def three_way_merges(spark, sf):
    """Each conversation's three first turns merged as base, mine and theirs."""
    c = read(spark, sf, "conversations").where("turn < 3").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", T.norms(F.col("text"), False).alias("ws")))).alias("t")).where(F.size("t") == 3)
    m = S.three_way_merge(*[F.get("t", F.lit(k))["ws"] for k in range(3)])
    return c.select("conv_id", m.alias("m")).select("conv_id", F.size("m.words").alias("n"), "m.conflicts", F.md5(F.array_join("m.words", " ").cast("binary")).alias("merged"))


_STATUS = "CASE n_chars % 6 WHEN 0 THEN 'excluded' WHEN 1 THEN 'ocr_done' WHEN 2 THEN 'error' WHEN 3 THEN 'processing' WHEN 4 THEN 'assembled' ELSE 'reviewed' END"


@query(f"""WITH p AS (SELECT source AS book, doc_id // 20 AS number, {_STATUS} AS status FROM documents), i AS (SELECT *, status IN ('reviewed', 'assembled') AS included FROM p WHERE status <> 'excluded'),
 b AS (SELECT *, max(CASE WHEN included THEN number END) OVER (PARTITION BY book ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)
 SELECT book, number, included, CASE WHEN status = 'ocr_done' THEN 'page_unreviewed' WHEN NOT included THEN CASE WHEN status = 'error' THEN 'page_error' ELSE 'page_pending' END END AS warning,
 CASE WHEN included AND before IS NOT NULL THEN (SELECT count(*) FROM i x WHERE x.book = b.book AND NOT x.included AND x.number > before AND x.number < b.number) END AS skipped FROM b""")
def page_selection(spark, sf):
    """Pages that enter a manuscript, their warnings, and how many were skipped before each (states from text lengths)."""
    states = ("excluded", "ocr_done", "error", "processing", "assembled", "reviewed")
    d = read(spark, sf, "documents")
    status = F.element_at(F.array(*[F.lit(s) for s in states]), (F.col("n_chars") % 6 + 1).cast("int"))
    p = d.select(F.col("source").alias("book"), F.floor(F.col("doc_id") / 20).cast("long").alias("number"), status.alias("status"))
    return W.select_pages(p, False).select("book", "number", "included", "warning", F.when(F.col("gap").isNotNull(), F.size("gap")).cast("long").alias("skipped"))


@query(f"""WITH {_PAGES}, {_ITEMS}, t AS (SELECT DISTINCT doc_id, unnest(ws) AS w FROM p), o AS (SELECT query, doc_id, count(*) AS n FROM t JOIN (SELECT DISTINCT query, unnest(qs) AS w FROM q) USING (w) GROUP BY ALL),
 c AS (SELECT query, arg_min(doc_id, (-n, doc_id)) AS doc_id FROM o GROUP BY query), a AS (SELECT query, w, count(*) AS k FROM (SELECT query, unnest(qs) AS w FROM q) GROUP BY ALL), b AS (SELECT query, w, count(*) AS k FROM (SELECT query, unnest(ws) AS w FROM c JOIN p USING (doc_id)) GROUP BY ALL),
 m AS (SELECT a.query, sum(least(a.k, b.k)) AS common FROM a JOIN b ON a.query = b.query AND a.w = b.w GROUP BY 1), s AS (SELECT c.query, c.doc_id, len(q.qs) AS r, len(p.ws) AS w, round(2.0 * coalesce(common, 0) / (len(q.qs) + len(p.ws)), 6) AS f1 FROM c JOIN q ON q.query = c.query JOIN p ON p.doc_id = c.doc_id LEFT JOIN m ON m.query = c.query),
 z AS (SELECT *, CASE WHEN w = 0 THEN 'empty' WHEN r = 0 THEN 'no_reference' WHEN r < 15 AND w > 3 * r + 10 THEN 'too_long' WHEN r < 15 THEN 'short_reference' WHEN w < 0.2 * r THEN 'too_short' WHEN w > 1.8 * r + 3 THEN 'too_long' WHEN f1 < 0.45 THEN 'low_overlap' ELSE 'ok' END AS reason FROM s)
 SELECT query, doc_id, f1, reason, reason IN ('ok', 'short_reference') AS ok FROM z""")
def reading_sanity(spark, sf):
    """Whether each item's best page reads like it: lengths and word F1."""
    ix = _index(spark, sf)
    best = X.overlaps(ix, _items(spark, sf), "doc_id", first=1).groupBy("query").agg(F.min_by("doc_id", F.struct(-F.col("overlap"), "doc_id")).alias("doc_id"))
    pairs = best.join(_items(spark, sf), "query").join(ix.select("doc_id", F.col("norms").alias("ws")), "doc_id")
    f1 = W.word_f1(pairs, "query", "ws", "words").select("query", F.round("f1", 6).alias("f1"))
    return pairs.join(f1, "query").select("query", "doc_id", "f1", W.sanity(F.size("ws"), F.size("words"), F.col("f1"), F.lit(False)).alias("s")).select("query", "doc_id", "f1", "s.reason", "s.ok")


@query("""WITH m AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS base, max(CASE WHEN turn = 1 THEN text END) AS mine, max(CASE WHEN turn = 2 THEN text END) AS fresh FROM conversations GROUP BY 1), n AS (SELECT conv_id, coalesce(mine, '') AS m, coalesce(base, '') AS b, coalesce(fresh, '') AS f, conv_id % 3 > 0 AS known FROM m)
 SELECT conv_id, CASE WHEN m = f THEN 'nothing' WHEN m = '' THEN CASE WHEN known AND b <> '' THEN CASE WHEN b = f THEN 'nothing' ELSE 'conflict' END WHEN known THEN 'insert' ELSE 'choose' END WHEN f = '' THEN CASE WHEN known THEN CASE WHEN m = b THEN 'remove' ELSE 'conflict' END ELSE 'choose' END WHEN NOT known THEN 'choose' WHEN m = b THEN 'take' WHEN f = b THEN 'nothing' ELSE 'merge' END AS decision FROM n""")
def merge_decisions(spark, sf):
    """What a change plan does with each block; three turns stand for base, mine and fresh."""
    side = lambda k, n: F.max(F.when(F.col("turn") == k, F.col("text"))).alias(n)
    m = read(spark, sf, "conversations").groupBy("conv_id").agg(side(0, "base"), side(1, "mine"), side(2, "fresh"))
    return m.select("conv_id", W.merge_decision(F.col("mine"), F.col("base"), F.col("fresh"), F.col("conv_id") % 3 > 0, F.lit(False)).alias("decision"))


@query("""WITH s AS (SELECT user_id % 10 AS book, user_id AS page, count(*) AS sig, max(value) > 50 AS reviewed FROM events WHERE event_type = 'view' GROUP BY 2), p AS (SELECT user_id % 10 AS book, user_id AS page, count(*) AS sig, max(value) > 50 AS reviewed FROM events WHERE event_type = 'click' GROUP BY 2)
 SELECT coalesce(s.book, p.book) AS book, count(*) FILTER (s.page IS NULL) AS added, count(*) FILTER (p.page IS NULL) AS removed, count(*) FILTER (s.sig <> p.sig) AS content, count(*) FILTER (s.sig = p.sig AND s.reviewed <> p.reviewed) AS approval FROM s FULL JOIN p ON s.book = p.book AND s.page = p.page GROUP BY 1""")
def staleness_reasons(spark, sf):
    """Why a manuscript is stale: pages added, removed, changed, or only approved since."""
    of = lambda kind: read(spark, sf, "events").where(F.col("event_type") == kind).groupBy((F.col("user_id") % 10).alias("book"), F.col("user_id").alias("page")).agg(F.count("*").alias("sig"), (F.max("value") > 50).alias("reviewed"))
    return W.staleness(of("view"), of("click"))


@query(r"""WITH w AS (SELECT doc_id, regexp_split_to_array(trim(text, chr(32)), '[ \t\n\x0B\f\r]+') AS ws FROM documents WHERE regexp_matches(text, '(?i)that')), t AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w), h AS (SELECT * FROM t WHERE regexp_matches(word, '(?i)^\P{L}*(?:that)\P{L}*$')), c AS (SELECT count(*) AS total FROM h)
 SELECT doc_id, i, word, array_to_string(ws[greatest(i - 4, 1) : i], ' ') AS before, array_to_string(ws[i + 2 : i + 6], ' ') AS after, total, total > 2000 AS truncated FROM h, c ORDER BY doc_id, i LIMIT 2000""")
def corpus_find(spark, sf):
    """A word in all texts with its context; the report is capped and says so."""
    return W.find(read(spark, sf, "documents"), "doc_id", "text", "that").withColumn("i", F.col("i").cast("long"))


@query()
def evaluation_report(spark, sf):
    """Verdicts on altered quotations, cut from every fiftieth page and checked against all pages."""
    ix = _index(spark, sf)
    return E.report(ix, E.cases(ix.where("doc_id % 50 = 0"), "doc_id", seed=1), "doc_id")
