"""Records of text files: CSV records that span lines, and JSON records split in good ones and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Column of the parser that holds a record it could not read.
_BROKEN = "_broken_record"


def csv_records(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """((file, record, value), (file, reason, value)): the records of CSV files, numbered from 0 within their file, and the files that have none.

    A line ends a record if the quotes up to it are even in number; line ends within a record become one newline. A file is
    split as Spark splits it: each block counts its quotes and, for either parity at its beginning, its records, and blocks
    are then put together by running sums over their totals. A file whose quotes are odd in number has no such records and is
    rejected as a whole.
    """
    raw = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    within = Window.partitionBy("file", "block").orderBy("place")
    before = F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = raw.withColumn("quotes", quotes).withColumn("odd", before % 2)
    lines = lines.withColumns({f"starts{p}": F.sum(F.when(F.col("odd") == p, 1).otherwise(0)).over(within.rowsBetween(Window.unboundedPreceding, 0)) for p in (0, 1)})

    totals = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), *(F.max(f"starts{p}").alias(f"all{p}") for p in (0, 1)))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("parity", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).withColumn("even", F.sum("quotes").over(Window.partitionBy("file")) % 2 == 0)
    totals = totals.withColumn("earlier", F.coalesce(F.sum(F.when(F.col("parity") == 0, F.col("all0")).otherwise(F.col("all1"))).over(earlier), F.lit(0)))

    placed = lines.drop("quotes").join(totals.filter("even").select("file", "block", "parity", "earlier"), ["file", "block"])
    record = F.col("earlier") + F.when(F.col("parity") == 0, F.col("starts0")).otherwise(F.col("starts1")) - 1
    parts = placed.groupBy("file", record.alias("record")).agg(F.array_sort(F.collect_list(F.struct("block", "place", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    records = parts.select("file", "record", F.when(F.col("record") == 0, F.regexp_replace(text, "^﻿", "")).otherwise(text).alias("value"))
    return records, totals.filter("not even").select("file", F.lit("a quote is left open").alias("reason"), F.lit(None).cast("string").alias("value")).distinct()


def json_records(raw: DataFrame, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """(file, value, row, reason) of (file, value): ``row`` by the schema, ``reason`` why it is none, else null."""
    row = F.from_json("value", f"{schema}, {_BROKEN} string", {"columnNameOfCorruptRecord": _BROKEN})
    checked = raw.withColumn("row", row).withColumn(
        "reason",
        F.when(F.try_parse_json("value").isNull(), "no JSON")
        .when(F.col("row").isNull() | F.col(f"row.{_BROKEN}").isNotNull(), "not of the schema")
        .otherwise(F.coalesce(*(F.when(F.col(f"row.{c}").isNull(), f"without {c}") for c in required), F.lit(None).cast("string"))),
    )
    return checked.withColumn("row", F.col("row").dropFields(_BROKEN))


def json_line_records(spark: SparkSession, paths, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """One record per line that is not blank."""
    return json_records(spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value").filter("trim(value) <> ''"), schema, required)


def json_file_records(spark: SparkSession, paths, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """One record per file that holds an object, and one per element of a file that holds an array."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    several = F.when(F.ltrim("value").startswith("["), F.coalesce(F.from_json("value", "array<string>"), F.array("value"))).otherwise(F.array("value"))
    return json_records(raw.select("file", F.explode(several).alias("value")), schema, required)


def good(records: DataFrame) -> DataFrame:
    return records.filter("reason is null").select("row.*")


def rejects(records: DataFrame) -> DataFrame:
    """(file, reason, value) of the records that are none."""
    return records.filter("reason is not null").select("file", "reason", "value")
