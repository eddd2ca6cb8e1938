"""Registered queries on annotations and line datasets.

Articles are (lang, source) of the documents, their lines the documents' non-blank text lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import annotations as A
from ..operators import dataset as D
from .inputs import GOLD_LINES, gold_lines, table


def _lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    article, page = F.concat_ws("_", "lang", "source"), (F.col("doc_id") % 7).cast("int")
    rows = docs.select(article.alias("article_id"), page.alias("page_index"), "doc_id", F.posexplode(X.cell_lines(F.col("text"))).alias("k", "text"))
    return rows.select("article_id", "page_index", (F.col("doc_id") * 100000 + F.col("k")).alias("line_index"), "text", F.when(F.col("k") % 4 == 0, "preview").otherwise("full").alias("source"))


def _test(spark, sf_dir):
    return _lines(spark, sf_dir).select("article_id").distinct().filter(F.endswith("article_id", F.lit("5")))


def _split(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    s = F.when(F.endswith("article_id", F.lit("5")), "test").when(F.endswith("article_id", F.lit("3")), "val").otherwise("train")
    return lines.withColumn("split", s)


LINES = r"""raw AS (SELECT lang || '_' || source AS article_id, CAST(doc_id % 7 AS INTEGER) AS page_index, doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
lines AS (SELECT article_id, page_index, doc_id * 100000 + k AS line_index, text, CASE WHEN k % 4 = 0 THEN 'preview' ELSE 'full' END AS source, CASE WHEN suffix(article_id, '5') THEN 'test' WHEN suffix(article_id, '3') THEN 'val' ELSE 'train' END AS split
  FROM (SELECT article_id, page_index, doc_id, unnest(l) AS text, unnest(range(0, len(l))) AS k FROM raw) AS r)"""


def article_split(spark, sf_dir):
    splits = D.split_articles(_lines(spark, sf_dir), _test(spark, sf_dir))
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("articles"))


def split_overlap(spark, sf_dir):
    """Overlaps of the split and, as a counterexample, of the split with every article that ends in 3 also put in test."""
    split = D.split_articles(_lines(spark, sf_dir), _test(spark, sf_dir)).select("article_id", "split")
    spoilt = split.unionByName(split.filter(F.endswith("article_id", F.lit("3"))).withColumn("split", F.lit("test")))
    count = lambda rows, name: D.overlapping_splits(rows).agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("overlapping"))
    return count(split, "sound").unionByName(count(spoilt, "spoilt"))


def split_stats(spark, sf_dir):
    return D.split_stats(_split(spark, sf_dir))


def crop_sources(spark, sf_dir):
    return D.source_counts(_split(spark, sf_dir))


def character_counts(spark, sf_dir):
    return D.character_counts(_lines(spark, sf_dir))


def character_set(spark, sf_dir):
    return D.character_set(_lines(spark, sf_dir), "aeq")


def line_length_quantiles(spark, sf_dir):
    return D.length_quantiles(_lines(spark, sf_dir))


def label_fix_counts(spark, sf_dir):
    return D.label_fixes(_lines(spark, sf_dir), (("th", "t"), ("t", "d"), ("dd", "d")))


def words_to_lines(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("block"), (F.col("l_linenumber") % 3).alias("line"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"), F.when(F.col("l_partkey") % 19 == 0, " ").otherwise(F.col("l_partkey").cast("string")).alias("text"),
        (F.col("l_quantity") - 3).alias("conf"), (F.col("l_suppkey") % 500).alias("left"), (F.col("l_partkey") % 300).alias("top"), (F.col("l_quantity").cast("long") + 5).alias("width"), F.lit(30).alias("height"),
    )
    return D.words_to_lines(w, ["block", "line"])


def _percent(spark, sf_dir, by_page=False):
    g = gold_lines(spark, sf_dir, by_page)
    return g.select("page_id", F.col("idx").alias("line_index"), (F.col("x1") / 12).alias("x"), (F.col("y1") / 4).alias("y"), F.when(F.col("idx") % 6 == 5, 0.0).otherwise((F.col("x2") - F.col("x1")) / 12).alias("width"), ((F.col("y2") - F.col("y1")) / 4).alias("height"), F.concat(F.lit("r"), "idx").alias("id"), "text")


def detector_labels(spark, sf_dir):
    return D.detector_labels(_percent(spark, sf_dir), ["page_id"])


def import_tasks(spark, sf_dir):
    """The tasks read back: regions of either type, their left edges and widths added up, and their texts in order. A task is a
    page's row, so its regions are counted where they are."""
    region = "struct<id:string,type:string,value:struct<x:double,width:double,text:array<string>>>"
    task = F.from_json("task", f"struct<data:struct<page_id:bigint>,predictions:array<struct<result:array<{region}>>>>")
    tasks = A.import_task(_percent(spark, sf_dir, by_page=True), ["page_id"]).select(task.alias("t")).select("t.data.page_id", F.col("t.predictions")[0]["result"].alias("r"))
    of = lambda kind: F.filter("r", lambda r: r["type"] == kind)
    total = lambda values: F.round(F.aggregate(F.array_compact(values), F.lit(None).cast("double"), lambda a, x: F.coalesce(a, F.lit(0.0)) + x), 3)
    return tasks.select(
        "page_id", F.size(of("rectangle")).cast("long").alias("rectangles"), F.size(of("textarea")).cast("long").alias("texts"), F.size(F.array_distinct(F.array_compact(F.col("r.id")))).cast("long").alias("ids"),
        total(F.col("r.value.x")).alias("left_edges"), total(F.col("r.value.width")).alias("widths"), F.array_join(F.transform(of("textarea"), lambda r: r["value"]["text"][0]), "\n").alias("text"),
    )


def short_articles(spark, sf_dir):
    return D.short_articles(_lines(spark, sf_dir), 40)


def article_totals(spark, sf_dir):
    return D.article_totals(_lines(spark, sf_dir))


def exported_pairs(spark, sf_dir):
    return D.exported_pairs(_lines(spark, sf_dir).withColumn("text", F.when(F.col("line_index") % 9 == 0, " ").otherwise(F.col("text"))))


def label_length(spark, sf_dir):
    return D.label_length(_lines(spark, sf_dir))


def issue_articles(spark, sf_dir):
    return D.of_issues(_lines(spark, sf_dir).select("article_id").distinct(), ["en_src1", "de_"])


def kept_pages(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    excluded = lines.select("article_id", "page_index").distinct().filter("page_index = 3")
    return D.keep_pages(lines, _test(spark, sf_dir), excluded).groupBy("article_id").agg(F.count(F.lit(1)).alias("lines"))


def _images(spark, sf_dir, least):
    return _lines(spark, sf_dir).select("article_id", "page_index").distinct().filter(F.col("page_index") >= least).withColumn("path", F.concat_ws("/", F.lit(f"img{least}"), "article_id", F.col("page_index").cast("string")))


def pages_without_image(spark, sf_dir):
    return D.pages_without_image(_lines(spark, sf_dir), _images(spark, sf_dir, 2), ["article_id", "page_index"])


def image_sources(spark, sf_dir):
    return D.image_source(_images(spark, sf_dir, 0).drop("path"), _images(spark, sf_dir, 4), _images(spark, sf_dir, 0), ["article_id", "page_index"])


def fixture_names(spark, sf_dir):
    wanted = _lines(spark, sf_dir).select("article_id", "page_index").distinct()
    file = F.when(F.col("page_index") % 2 == 0, F.concat_ws("_p", "article_id", F.col("page_index").cast("string"))).otherwise(F.concat_ws("_", "article_id", F.col("page_index").cast("string")))
    files = wanted.select(file.alias("name")).union(wanted.filter("page_index = 0").select(F.concat_ws("_", "article_id", F.lit("0"))))
    page = F.col("page_index").cast("string")
    return D.first_existing(wanted, files, F.array(F.concat_ws("_", "article_id", page), F.concat_ws("_p", "article_id", page), F.col("article_id")))


def latest_pages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return A.latest_per_page(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


def dropped_pages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return A.latest_per_page(e, ["user_id", "event_type"], "ts", "event_id", "dropped").groupBy("event_type").agg(F.count(F.lit(1)).alias("dropped"))


def box_texts(spark, sf_dir):
    g = _percent(spark, sf_dir)
    texts = g.filter("(page_id + line_index) % 4 <> 0").select("page_id", "id", "text")
    return A.join_regions(g.drop("text"), texts, ["page_id", "id"]).select("page_id", "line_index", "text")


def untexted_boxes(spark, sf_dir):
    return A.untexted_boxes(box_texts(spark, sf_dir), ["page_id"])


def assigned_lines(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    truth = lines.filter("line_index % 5 <> 0").select("article_id", F.col("line_index").alias("ord"), "text")
    return A.assign_lines(lines.drop("text"), truth).select("article_id", "line_index", F.md5(F.col("text").cast("binary")).alias("text"))


def lines_before_page(spark, sf_dir):
    return A.lines_before_page(_lines(spark, sf_dir).groupBy("article_id", "page_index").agg(F.count(F.lit(1)).alias("lines")))


def count_differences(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return A.count_differences(lines, lines.filter("line_index % 30 <> 0 or page_index = 1"))


def paired_by_position(spark, sf_dir):
    g = gold_lines(spark, sf_dir)
    right = g.filter("(page_id + idx) % 3 <> 0").select("page_id", F.col("idx").alias("r"))
    return A.pair_by_position(g.select("page_id", F.col("idx").alias("l")), right, "page_id", "l", "r")


def best_sheets(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("article_id"), F.concat(F.when(F.col("o_orderkey") % 3 == 0, "DONE ").otherwise(""), "o_orderstatus").alias("name"), (F.col("o_orderpriority") == "1-URGENT").alias("native"), F.col("o_orderdate").alias("modified"), F.col("o_orderkey").alias("ord"))
    return A.best_sheet(s).select("article_id", "ord", "matches")


def articles_without_sheet(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k")).distinct()
    return A.discover(c, o, "k")[1]


def ready_articles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey")).alias("scan"), F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.when(F.col("o_orderkey") % 3 == 0, "DONE ").otherwise(""), "o_orderstatus")).alias("sheet"))
    return A.ready_articles(o)[0].select("o_orderkey")


def replaced_page(spark, sf_dir):
    g = gold_lines(spark, sf_dir).select("page_id", "idx", "text")
    new = g.filter("page_id % 10 = 0 and idx = 1").withColumn("text", F.lit("new"))
    return A.replace_page(g, new, ["page_id"]).groupBy((F.col("page_id") % 10).alias("digit")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("text") == "new").alias("new"))


def outlier_boxes(spark, sf_dir):
    g = gold_lines(spark, sf_dir).withColumn("y2", F.when((F.col("page_id") + F.col("idx")) % 6 == 0, F.col("y1") + 60).otherwise(F.col("y2")))
    return A.outlier_boxes(g, ["page_id"]).groupBy("page_id").agg(F.max("median").alias("median"), F.count_if("outlier").alias("outliers"))


def truth_columns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    cells = c.select(F.col("conv_id").alias("article_id"), F.col("turn").cast("int").alias("row"), F.explode(F.array(F.struct(F.lit(0).alias("col"), F.col("text").alias("value")), F.struct(F.lit(1).alias("col"), F.regexp_replace("text", "[a-z]", "é").alias("value")), F.struct(F.lit(2).alias("col"), F.when(F.col("turn") == 1, "abc").otherwise("  ").alias("value")))).alias("x")).select("article_id", "row", "x.*")
    return A.truth_column(cells, block="a-z", strict=False)


TRUTH_COLUMNS = r"""
WITH cells AS (
  SELECT conv_id AS article_id, turn AS row, unnest([0, 1, 2]) AS col, unnest([text, regexp_replace(text, '[a-z]', 'é', 'g'), CASE WHEN turn = 1 THEN 'abc' ELSE '  ' END]) AS value FROM conversations
), rows AS (SELECT * FROM cells WHERE row BETWEEN 1 AND 8), counts AS (SELECT article_id, count(DISTINCT row) AS n FROM rows GROUP BY 1),
letters AS (SELECT article_id, col, regexp_replace(value, '[^\p{L}]', '', 'g') AS l FROM rows WHERE regexp_replace(value, '[\s\x1c-\x1f]+', '', 'g') <> ''),
filled AS (SELECT article_id, col, count(*) AS k, avg(CASE WHEN length(l) > 0 THEN (length(l) - length(regexp_replace(l, '[a-z]', '', 'g'))) / length(l) ELSE 0 END) AS share FROM letters GROUP BY 1, 2)
SELECT c.article_id, CAST(max(f.col) AS INTEGER) AS truth_col FROM counts c LEFT JOIN filled f ON f.article_id = c.article_id AND f.k >= greatest(2, c.n // 2) AND f.share > 0.5 GROUP BY 1
"""
PERCENT = f"{GOLD_LINES}, pct AS (SELECT page_id, idx, text, x1, y1, CASE WHEN idx % 6 = 5 THEN 0 ELSE x2 - x1 END AS width, y2 - y1 AS height FROM gold)"

QUERIES = {
    "dataset_article_split": (article_split, f"WITH {LINES}, a AS (SELECT DISTINCT article_id FROM lines), n AS (SELECT count_if(suffix(article_id, '5')) AS t, count_if(NOT suffix(article_id, '5')) AS r FROM a), v AS (SELECT t, r, greatest(1, CAST(round_even(0.12::DOUBLE * r, 0) AS BIGINT)) AS v FROM n) SELECT 'test' AS split, t AS articles FROM v UNION ALL SELECT 'val', v FROM v UNION ALL SELECT 'train', r - v FROM v"),
    "dataset_split_overlap": (split_overlap, f"WITH {LINES} SELECT 'sound' AS dataset, 0 AS overlapping UNION ALL SELECT 'spoilt', count(DISTINCT article_id) FROM lines WHERE suffix(article_id, '3')"),
    "dataset_split_stats": (split_stats, f"WITH {LINES} SELECT split, count(*) AS lines, count(DISTINCT article_id) AS articles, count(DISTINCT (article_id, page_index)) AS pages, string_agg(DISTINCT article_id, ',' ORDER BY article_id) AS article_list FROM lines GROUP BY split"),
    "dataset_crop_sources": (crop_sources, f"WITH {LINES} SELECT split, source, count(*) AS lines FROM lines GROUP BY 1, 2"),
    "dataset_character_counts": (character_counts, f"WITH {LINES} SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM lines) AS c GROUP BY ch"),
    "dataset_character_set": (character_set, f"WITH {LINES}, c AS (SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM lines) AS c GROUP BY ch) SELECT count(*) AS size, string_agg(ch, '' ORDER BY ch) AS charset, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (ch = '{c}'), 0) AS BIGINT) AS special_{i}" for i, c in enumerate("aeq")) + " FROM c"),
    "dataset_line_length_quantiles": (line_length_quantiles, f"WITH {LINES}, o AS (SELECT length(text) AS len, row_number() OVER (ORDER BY length(text)) - 1 AS k, count(*) OVER () AS n FROM lines) SELECT min(len) AS min, " + ", ".join(f"max(len) FILTER (k = {e}) AS {a}" for e, a in (("n // 2", "median"), ("CAST(floor(n * 0.95::DOUBLE) AS BIGINT)", "p95"), ("CAST(floor(n * 0.99::DOUBLE) AS BIGINT)", "p99"))) + ", max(len) AS max FROM o"),
    "dataset_label_fixes": (label_fix_counts, f"WITH {LINES}, a AS (SELECT text AS t0, replace(text, 'th', 't') AS t1, replace(replace(text, 'th', 't'), 't', 'd') AS t2 FROM lines) SELECT * FROM (SELECT 'th->t' AS rule, CAST(sum(length(t0) - length(replace(t0, 'th', ''))) / 2 AS BIGINT) AS n FROM a UNION ALL SELECT 't->d', CAST(sum(length(t1) - length(replace(t1, 't', ''))) AS BIGINT) FROM a UNION ALL SELECT 'dd->d', CAST(sum(length(t2) - length(replace(t2, 'dd', ''))) / 2 AS BIGINT) FROM a) AS r WHERE n > 0"),
    "ocr_words_to_lines": (
        words_to_lines,
        """WITH w AS (SELECT l_orderkey AS block, l_linenumber % 3 AS line, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity - 3 AS conf, l_suppkey % 500 AS x, l_partkey % 300 AS y, CAST(l_quantity AS BIGINT) + 5 AS w FROM lineitem WHERE l_partkey % 19 <> 0 AND l_quantity >= 3)
        SELECT block, line, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text, min(x) AS left, min(y) AS top, max(x + w) - min(x) AS width, max(y + 30) - min(y) AS height, round(avg(conf) / 100, 4) AS confidence FROM w GROUP BY block, line""",
    ),
    "detector_label_lines": (detector_labels, f"""WITH {PERCENT}, c AS (SELECT page_id, idx, least(1, greatest(0, (x1 / 12 + width / 24) / 100)) AS cx, least(1, greatest(0, (y1 / 4 + height / 8) / 100)) AS cy, least(1, greatest(0, width / 1200)) AS w, least(1, greatest(0, height / 400)) AS h FROM pct WHERE width > 0 AND height > 0)
        SELECT page_id, string_agg(printf('0 %.6f %.6f %.6f %.6f', cx, cy, w, h), chr(10) ORDER BY idx) AS label FROM c GROUP BY page_id"""),
    "annotation_import_tasks": (
        import_tasks,
        f"WITH {PERCENT} SELECT page_id, count(*) AS rectangles, count(*) AS texts, count(*) AS ids, round(2 * sum(x1 / 12), 3) AS left_edges, round(2 * sum(width / 12), 3) AS widths, string_agg(text, chr(10) ORDER BY idx) AS text FROM pct GROUP BY page_id",
    ),
    "dataset_short_articles": (short_articles, f"WITH {LINES} SELECT article_id, count(*) AS lines, count(*) < 40 AS suspicious FROM lines GROUP BY 1"),
    "dataset_article_totals": (article_totals, f"WITH {LINES}, p AS (SELECT article_id, page_index, count(*) AS n FROM lines GROUP BY 1, 2) SELECT article_id, count(*) AS pages, CAST(sum(n) AS BIGINT) AS lines FROM p GROUP BY ROLLUP (article_id)"),
    "dataset_exported_pairs": (exported_pairs, f"WITH {LINES} SELECT article_id, count(*) AS pairs FROM lines WHERE line_index % 9 <> 0 GROUP BY ROLLUP (article_id)"),
    "dataset_label_length": (label_length, f"WITH {LINES} SELECT least(512, max(length(text)) + 8) AS max_label_length FROM lines"),
    "dataset_issue_articles": (issue_articles, f"WITH {LINES} SELECT DISTINCT article_id FROM lines WHERE starts_with(article_id, 'en_src1') OR starts_with(article_id, 'de_')"),
    "dataset_kept_pages": (kept_pages, f"WITH {LINES} SELECT article_id, count(*) AS lines FROM lines WHERE suffix(article_id, '5') AND page_index <> 3 GROUP BY 1"),
    "dataset_pages_without_image": (pages_without_image, f"WITH {LINES} SELECT DISTINCT article_id, page_index FROM lines WHERE page_index < 2"),
    "dataset_image_sources": (image_sources, f"WITH {LINES} SELECT DISTINCT article_id, page_index, CASE WHEN page_index >= 4 THEN 'full' ELSE 'preview' END AS source, CASE WHEN page_index >= 4 THEN 'img4/' ELSE 'img0/' END || article_id || '/' || page_index AS path FROM lines"),
    "dataset_fixture_names": (fixture_names, f"WITH {LINES} SELECT DISTINCT article_id, page_index, article_id || CASE WHEN page_index % 2 = 1 OR page_index = 0 THEN '_' ELSE '_p' END || page_index AS name FROM lines"),
    "annotation_latest_pages": (latest_pages, "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) AS e WHERE k = 1"),
    "annotation_dropped_pages": (dropped_pages, "SELECT event_type, count(*) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) AS e WHERE k > 1 GROUP BY 1"),
    "annotation_box_texts": (box_texts, f"WITH {GOLD_LINES} SELECT page_id, idx AS line_index, CASE WHEN (page_id + idx) % 4 <> 0 THEN text ELSE '' END AS text FROM gold"),
    "annotation_untexted_boxes": (untexted_boxes, f"WITH {GOLD_LINES} SELECT page_id, count(*) AS lines, count_if((page_id + idx) % 4 = 0) AS untexted, bool_or((page_id + idx) % 4 = 0) AS incomplete FROM gold GROUP BY page_id"),
    "annotation_assigned_lines": (assigned_lines, f"WITH {LINES}, b AS (SELECT article_id, line_index, row_number() OVER (PARTITION BY article_id ORDER BY page_index, line_index) AS n FROM lines), t AS (SELECT article_id, text, row_number() OVER (PARTITION BY article_id ORDER BY line_index) AS n FROM lines WHERE line_index % 5 <> 0) SELECT b.article_id, line_index, md5(coalesce(text, '')) AS text FROM b LEFT JOIN t ON t.article_id = b.article_id AND t.n = b.n"),
    "annotation_lines_before_page": (lines_before_page, f"WITH {LINES}, p AS (SELECT article_id, page_index, count(*) AS lines FROM lines GROUP BY 1, 2) SELECT *, CAST(coalesce(sum(lines) OVER (PARTITION BY article_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM p"),
    "annotation_count_differences": (count_differences, f"WITH {LINES} SELECT article_id, count(*) AS boxes, count_if(line_index % 30 <> 0 OR page_index = 1) AS lines, count_if(line_index % 30 = 0 AND page_index <> 1) AS diff, count_if(line_index % 30 = 0 AND page_index <> 1) = 0 AS equal, count_if(line_index % 30 = 0 AND page_index <> 1) > 3 AS far FROM lines GROUP BY 1"),
    "annotation_paired_by_position": (paired_by_position, f"WITH {GOLD_LINES}, a AS (SELECT page_id, idx AS l, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS n FROM gold), b AS (SELECT page_id, idx AS r, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS n FROM gold WHERE (page_id + idx) % 3 <> 0) SELECT a.page_id, l, r FROM a JOIN b ON a.page_id = b.page_id AND a.n = b.n"),
    "annotation_best_sheets": (best_sheets, "SELECT o_custkey AS article_id, o_orderkey AS ord, m AS matches FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderkey % 3 = 0 DESC, o_orderdate DESC, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders) AS o WHERE k = 1"),
    "annotation_articles_without_sheet": (articles_without_sheet, "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)"),
    "annotation_ready_articles": (ready_articles, "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 3 = 0"),
    "annotation_replaced_page": (replaced_page, f"WITH {GOLD_LINES} SELECT page_id % 10 AS digit, count_if(NOT (page_id % 10 = 0 AND one) OR (page_id % 10 = 0 AND idx = 1)) AS lines, count_if(page_id % 10 = 0 AND idx = 1) AS new FROM (SELECT *, bool_or(idx = 1) OVER (PARTITION BY page_id) AS one FROM gold) AS g GROUP BY 1"),
    "annotation_outlier_boxes": (outlier_boxes, f"WITH {GOLD_LINES}, h AS (SELECT page_id, idx, CASE WHEN (page_id + idx) % 6 = 0 THEN 60 ELSE y2 - y1 END AS h FROM gold), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY h) - 1 AS k, count(*) OVER (PARTITION BY page_id) AS n FROM h), m AS (SELECT page_id, max(h) FILTER (k = n // 2) AS median, max(n) AS n FROM r GROUP BY 1) SELECT page_id, any_value(median) AS median, count_if(m.n >= 3 AND h > 1.6::DOUBLE * median) AS outliers FROM h JOIN m USING (page_id) GROUP BY page_id"),
    "annotation_truth_columns": (truth_columns, TRUTH_COLUMNS),
}
