"""Queries that go through storage and streams and come back as rows: bundles, exports, fixes, streams, index versions.

Letters of documents stand for Arabic ones where a function needs these; DuckDB's translate gives the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import review as W
from ..sources import bundle
from ..storage import new_path, spread
from ..streaming import jobs, snapshots
from .registry import query, read
from .texts import _PAGES

#: Latin letters in order, and the Arabic ones (with forms that fold) that stand for them.
LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقأىةئؤ"
_WORDS = f"w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS raw FROM documents), a AS (SELECT raw, translate(raw, '{LATIN}', '{ARABIC}') AS t FROM w)"
_SKELETON = "".join(T.SKELETON.values()), "".join(form * len(group) for form, group in T.SKELETON.items())


@query(rf"""WITH {_WORDS} SELECT raw, regexp_replace(translate(t, '{T.FOLD_FROM}', '{T.FOLD_TO}'), '[^\p{{L}}\p{{N}}]', '', 'g') AS norm, translate(replace(regexp_replace(t, '[^ء-يٱ]', '', 'g'), 'ء', ''), '{_SKELETON[0]}', '{_SKELETON[1]}') AS skeleton,
 regexp_matches(t, '^[0-9]+$') AS digits, regexp_matches(t, '[0-9]') AS has_digit, t = regexp_replace(t, '[ء-ي]', '', 'g') AS no_letter, length(regexp_replace(t, '[^ء-ي]', '', 'g')) / nullif(length(regexp_replace(t, '[0-9]', '', 'g')), 0) AS share FROM a""")
def word_forms(spark, sf):
    """Normal form, dotless skeleton and kinds of every distinct word."""
    words = F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")))
    a = spread(read(spark, sf, "documents")).select(words.alias("raw")).distinct().withColumn("t", F.translate("raw", LATIN, ARABIC))
    t = F.col("t")
    return a.select("raw", T.normalize_word(t).alias("norm"), T.skeleton(t).alias("skeleton"), T.is_digit_token(t).alias("digits"), T.has_digit(t).alias("has_digit"), (~t.rlike("[ء-ي]")).alias("no_letter"), F.when(t.rlike(r"\p{L}"), T.arabic_ratio(t)).alias("share"))


@query(f"""WITH {_WORDS} SELECT raw, regexp_matches(x, '^[(\\[«]?[اأإآهع]{{1,2}}ـ?[)\\]»]?[.،:؛]?$') AS lone_letter, regexp_replace(x, '[ًٌٍَُِّْـ]', '', 'g') AS plain, x <> t AS marked FROM (SELECT raw, t, CASE WHEN length(raw) % 3 = 0 THEN substr(t, 1, 1) || 'َ' || substr(t, 2) WHEN length(raw) % 3 = 1 THEN substr(t, 1, 1) || 'ـ' || substr(t, 2) ELSE t END AS x FROM a)""")
def word_marks(spark, sf):
    """Words with a vowel mark or tatweel put in: lone letters, the words without marks, and whether they are marked."""
    words = F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")))
    a = spread(read(spark, sf, "documents")).select(words.alias("raw")).distinct().withColumn("t", F.translate("raw", LATIN, ARABIC))
    put = lambda mark: F.concat(F.substring("t", 1, 1), F.lit(mark), F.substr("t", F.lit(2)))
    x = F.when(F.length("raw") % 3 == 0, put("َ")).when(F.length("raw") % 3 == 1, put("ـ")).otherwise(F.col("t"))
    return a.withColumn("x", x).select("raw", F.col("x").rlike(W.LONE_LETTER).alias("lone_letter"), T.strip_tashkeel(F.col("x")).alias("plain"), (T.has_diacritics(F.col("x")) | F.col("x").contains("ـ")).alias("marked"))


@query("""SELECT o.o_orderkey, CAST(o.o_custkey + 1000000 AS BIGINT) AS o_custkey, o.o_totalprice, o.o_orderdate, CASE WHEN o.o_custkey % 2 = 0 THEN c.c_custkey + 5 END AS owner FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""")
def bundle_round_trip(spark, sf):
    """Tables written as a bundle with its manifest, read back, and their ids replaced."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = read(spark, sf, "customer").select("c_custkey", "c_name")
    path = new_path(spark, "bundle")
    bundle.write_bundle({"orders": orders, "customer": customer}, path)
    back = bundle.read_bundle(spark, path)
    ids = back["customer"].select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1_000_000).alias("new"))
    some = back["customer"].where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 5).alias("new"))
    known = back["orders"].join(back["customer"].select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").withColumn("owner", F.col("o_custkey"))
    return bundle.remap(bundle.remap(known, some, "owner"), ids, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "owner")


@query(r"""WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND trim(text, ' ') <> '' THEN text WHEN turn % 3 = 1 THEN '  ' ELSE NULL END AS f, CASE WHEN turn % 2 = 0 THEN text END AS d FROM conversations), t AS (SELECT conv_id, turn, coalesce(nullif(trim(f, ' '), ''), nullif(trim(d, ' '), '')) AS t FROM p)
 SELECT conv_id AS book, md5(string_agg(t, chr(10) || chr(10) ORDER BY turn, t)) AS text_md5, count(*) AS pages FROM t WHERE t IS NOT NULL GROUP BY 1""")
def exported_books(spark, sf):
    """Books as one text each: final text before the provisional, empty pages left out."""
    c = read(spark, sf, "conversations")
    final = F.when((F.col("turn") % 3 == 0) & (F.trim("text") != ""), F.col("text")).when(F.col("turn") % 3 == 1, "  ")
    pages = c.select("conv_id", "turn", final.alias("final"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("draft"))
    text = bundle.export_books(pages, "conv_id", "turn", "final", "draft")
    some = F.coalesce(F.nullif(F.trim("final"), F.lit("")), F.nullif(F.trim("draft"), F.lit("")))
    n = pages.where(some.isNotNull()).groupBy("conv_id").agg(F.count("*").alias("pages"))
    return text.join(n, "conv_id").select(F.col("conv_id").alias("book"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "pages")


@query("""WITH p AS (SELECT user_id, event_id, event_type AS t, value < 60 AS editable, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'other' END AS seen FROM events)
 SELECT user_id AS line, event_id AS i, CASE WHEN seen IS NOT NULL AND editable AND t = seen THEN 'new' ELSE t END AS t, CASE WHEN seen IS NOT NULL AND editable AND t = seen THEN t END AS orig, CASE WHEN seen IS NULL THEN NULL WHEN NOT editable THEN 'page' WHEN t <> seen THEN 'changed' ELSE 'applied' END AS outcome FROM p""")
def batch_fix(spark, sf):
    """A batch of word fixes: applied where the word still reads as seen, else the reason why not."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("line"), F.col("event_id").alias("i"), F.col("event_type").alias("t"), F.lit(None).cast("string").alias("orig"), (F.col("value") < 60).alias("editable"))
    seen = F.when(F.col("i") % 3 == 0, F.col("t")).when(F.col("i") % 3 == 1, "other")
    picks = e.select("line", "i", seen.alias("seen"), F.lit("new").alias("new")).where("seen IS NOT NULL")
    return W.fix(e, picks).select("line", "i", "t", "orig", "outcome")


@query("""WITH r AS (SELECT event_id AS id, user_id AS line, ts, CASE WHEN event_type IN ('click', 'error') THEN 'b1' ELSE 'b2' END AS batch, event_type = 'view' AND value < 50 AS undone FROM events), t AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY ts DESC, id DESC) AS n FROM r WHERE NOT undone) SELECT line, min(n) = 1 AS undo FROM t WHERE batch = 'b1' GROUP BY line""")
def batch_undo(spark, sf):
    """Which lines of a batch can be taken back: those whose newest live revision is the batch's."""
    r = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("line"), F.col("ts").alias("created_at"), F.when(F.col("event_type").isin("click", "error"), "b1").otherwise("b2").alias("batch"), ((F.col("event_type") == "view") & (F.col("value") < 50)).alias("undone"))
    return W.undoable(r, "b1")




def _streamed(spark, sf, name: str, made, mode: str = "append") -> DataFrame:
    """What a stream over a table's files writes, run to the end of what is there.  A pattern, as a table may be one file or a folder."""
    table = read(spark, sf, name)
    out, state = new_path(spark, "stream"), new_path(spark, "stream-state")
    run = made(spark.readStream.schema(table.schema).parquet(f"{sf}/{name}.parque[t]")).writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start(out)
    run.awaitTermination()
    return spark.read.parquet(out)


@query("""SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL""")
def stream_once(spark, sf):
    """Events consumed once a key from a stream: how often each key came through."""
    got = _streamed(spark, sf, "events", lambda s: jobs.consume_once(s.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), ["user_id", "event_type"], "ts", delay="400 days"))
    return got.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT user_id, unnest(range(0, 6)) AS k, ts FROM events), u AS (SELECT user_id, to_timestamp(10 * (epoch_us(ts) // 10000000) + 10 * k + 10) AS until FROM w), c AS (SELECT user_id, CAST(until AT TIME ZONE 'UTC' AS TIMESTAMP) AS until, count(*) AS calls FROM u GROUP BY ALL), m AS (SELECT max(ts) AS now FROM events)
 SELECT user_id, until, calls, calls >= 2 AS limited FROM c, m WHERE until <= now - INTERVAL 1 MINUTE""")
def stream_call_rates(spark, sf):
    """Calls of each user in sliding minutes of a stream, for all minutes that the watermark has closed."""
    got = _streamed(spark, sf, "events", lambda s: jobs.call_rates(s.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", limit=2))
    return got.select("user_id", F.col("until").cast("timestamp_ntz").alias("until"), "calls", "limited")


@query(f"""WITH {_PAGES} SELECT book, count(*) AS pages, CAST(sum(len(ws)) AS BIGINT) AS words, md5(string_agg(CAST(doc_id AS VARCHAR) || ':' || len(ws), ',' ORDER BY doc_id)) AS sizes_md5 FROM p WHERE len(ws) > 0 AND doc_id % 17 > 0 GROUP BY book""")
def versioned_index(spark, sf):
    """The index after three batches of changed pages, each one version: old texts, new texts, and pages that are emptied."""
    pages = read(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("book"), "text")
    path = new_path(spark, "versions")
    batch = lambda rows, text, version: snapshots.apply(rows.select("page_id", "book", text.alias("text"), F.lit(version).alias("version")), path)
    batch(pages, F.concat(F.lit("old text of page "), F.col("page_id").cast("string")), 1)
    batch(pages, F.col("text"), 2)
    batch(pages.where("page_id % 17 = 0"), F.lit(""), 3)
    size = F.concat(F.col("page_id").cast("string"), F.lit(":"), F.size("norms").cast("string"))
    sizes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", size.alias("s")))), lambda x: x["s"]), ",")
    ix = snapshots.read(spark, path)
    return ix.groupBy("book").agg(F.count("*").alias("pages"), F.sum(F.size("norms")).cast("long").alias("words"), F.md5(sizes.cast("binary")).alias("sizes_md5"))
