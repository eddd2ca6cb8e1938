"""Inputs that the registered queries derive from the given tables, in Spark and in DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


LINES_A_TASK = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows with much work each, over all cores: those of a small table come in fewer splits than there are cores. Larger tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def edited(text):
    """A deterministic second reading of a text."""
    return F.replace(F.replace(F.replace(text, F.lit("tion"), F.lit("sion")), F.lit("ea"), F.lit("e")), F.lit("th"), F.lit("t"))


#: DuckDB's levenshtein counts bytes. For it alone each letter of the given texts that has two bytes is read as one unused byte.
_LETTERS = "óéñèíüçêäößÉÑÈÓÜÍÇÖÊÄ"
_UNUSED = "".join(map(chr, [*range(1, 9), 11, 12, *range(14, 25)]))
SQL_BYTES = f"translate({{c}}, '{_LETTERS}', '{_UNUSED}')"
SQL_EDITED = "replace(replace(replace({c}, 'tion', 'sion'), 'ea', 'e'), 'th', 't')"


def reading_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, article_id, a, b): every chat turn's whole text and its edited copy, by conversation."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), F.concat(F.lit("c"), F.col("conv_id") % 10).alias("article_id"), F.coalesce("text", F.lit("")).alias("a"))
    return dealt(turns).withColumn("b", edited(F.col("a")))


READING_PAIRS = f"""pairs AS (
  SELECT doc_id, article_id, a, {SQL_EDITED.format(c="a")} AS b FROM (
    SELECT conv_id * 100 + turn AS doc_id, 'c' || (conv_id % 10) AS article_id, coalesce(text, '') AS a FROM conversations) AS t
)"""


def gold_lines(spark: SparkSession, sf_dir: str, by_page: bool = False) -> DataFrame:
    """Text line boxes: an order is a page, its lines stand below each other in two columns. ``by_page``: dealt out by page at
    once, for steps that need a page's lines together, so that there is one shuffle and not two. A task gets LINES_A_TASK lines
    or so, however large the table is."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus", "l_returnflag")
    if by_page:
        items = items.repartition(max(spark.sparkContext.defaultParallelism, -(-items.count() // LINES_A_TASK)), "l_orderkey")
    li = items.groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("long").alias("idx"))
    first = li.agg(F.min(F.struct("l_partkey", "l_linestatus", "l_returnflag")).alias("l")).select("page_id", "idx", "l.*")
    n, k = F.col("idx"), F.col("l_partkey")
    x1 = F.when(n % 2 == 0, 560.0).otherwise(100.0)
    return first.select(
        "page_id", "idx", x1.alias("x1"), (n * 30.0).alias("y1"), (x1 + 340 + k % 100).alias("x2"), (n * 30.0 + 20 + k % 7).alias("y2"),
        F.concat_ws(" ", F.lit("line"), k.cast("string"), F.col("l_linestatus"), F.col("l_returnflag")).alias("text"),
    )


GOLD_LINES = """gold AS (
  SELECT page_id, idx, x1, y1, x1 + 340 + k % 100 AS x2, y1 + 20 + k % 7 AS y2, text FROM (
    SELECT l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) AS idx, CASE WHEN CAST(l_linenumber AS BIGINT) % 2 = 0 THEN 560.0::DOUBLE ELSE 100.0::DOUBLE END AS x1,
           CAST(l_linenumber AS BIGINT) * 30.0::DOUBLE AS y1, l_partkey AS k, concat_ws(' ', 'line', CAST(l_partkey AS VARCHAR), l_linestatus, l_returnflag) AS text,
           row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_linestatus, l_returnflag) AS first FROM lineitem) AS l WHERE first = 1
)"""


def predicted_lines(gold: DataFrame) -> DataFrame:
    """Shifted, renamed and thinned boxes with a confidence, as a detector and recogniser might give them."""
    h = (F.col("page_id") * 7 + F.col("idx") * 13) % 100
    rows = gold.withColumn("h", h).filter("h >= 8")
    text = F.when(F.col("h") % 5 == 0, F.concat("text", F.lit("aaaaaaaa"))).when(F.col("h") % 5 == 1, F.substring("text", 1, 5)).when(F.col("h") % 5 == 2, F.replace("text", F.lit("line"), F.lit("lime"))).otherwise(F.col("text"))
    far = F.when(F.col("h") >= 95, 2000.0).otherwise(0.0)
    return rows.select(
        "page_id", "idx", (F.col("x1") + F.col("h") % 11).alias("x1"), (F.col("y1") + F.col("h") % 9 + far).alias("y1"), (F.col("x2") + F.col("h") % 5).alias("x2"), (F.col("y2") + F.col("h") % 9 + far).alias("y2"),
        F.when(F.col("h") % 10 == 3, None).otherwise(F.col("h") / 100).alias("conf"), text.alias("text"),
    )


PREDICTED_LINES = """pred AS (
  SELECT page_id, idx, x1 + h % 11 AS x1, y1 + h % 9 + far AS y1, x2 + h % 5 AS x2, y2 + h % 9 + far AS y2, CASE WHEN h % 10 = 3 THEN NULL ELSE h / 100 END AS conf,
    CASE WHEN h % 5 = 0 THEN text || 'aaaaaaaa' WHEN h % 5 = 1 THEN substr(text, 1, 5) WHEN h % 5 = 2 THEN replace(text, 'line', 'lime') ELSE text END AS text
  FROM (SELECT *, (page_id * 7 + idx * 13) % 100 AS h, CASE WHEN (page_id * 7 + idx * 13) % 100 >= 95 THEN 2000.0::DOUBLE ELSE 0.0::DOUBLE END AS far FROM gold) AS g WHERE h >= 8
)"""


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a run log: a user's day is a run, event types are stages."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 80, "needs_review").otherwise("completed")
    return e.select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("run_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("stage"), status.alias("status"), F.col("value").alias("duration"))


RUN_EVENTS = """run_events AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS run_id, event_id AS seq, ts, event_type AS stage,
         CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 80 THEN 'needs_review' ELSE 'completed' END AS status, value AS duration FROM events
)"""
