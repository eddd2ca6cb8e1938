"""Writers: results as tables and files, partitioned, never collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lexicon(df: DataFrame, report: DataFrame, path: str) -> None:
    df.write.parquet(f"{path}/lexicon")
    report.write.json(f"{path}/report")


def cases(df: DataFrame, path: str) -> None:
    """Ambiguous and unknown words, with the source they came from."""
    df.filter("status <> 'known'").write.json(path)


def by_split(lines: DataFrame, path: str) -> None:
    lines.write.partitionBy("split").csv(path, header=True)


def by_article(labels: DataFrame, path: str) -> None:
    labels.select("article_id", "file_name", "text").write.partitionBy("article_id").csv(path, header=True)


def replace_pages(new: DataFrame, path: str, keys: tuple = ("article_id", "page_index")) -> None:
    """Overwrites only the partitions that ``new`` has rows of."""
    new.write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def detector_labels(labels: DataFrame, path: str) -> None:
    labels.select("split", F.col("label").alias("value")).write.partitionBy("split").text(path)


def tasks(df: DataFrame, path: str) -> None:
    df.select(F.col("task").alias("value")).write.text(path)


def evaluation(pages: DataFrame, predictions: DataFrame, report: DataFrame, path: str) -> None:
    pages.write.csv(f"{path}/pages", header=True)
    predictions.write.json(f"{path}/predictions")
    report.write.json(f"{path}/report")


def pipeline_results(results: DataFrame, path: str, stages: tuple = ()) -> None:
    """One wide table by day, and each stage's text on its own."""
    results.withColumn("run_date", F.to_date("finished_at")).write.partitionBy("run_date").parquet(f"{path}/runs")
    for s in stages:
        results.select("run_id", F.col(s).alias("text")).write.json(f"{path}/{s}")


def original(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Written once; only an explicit request overwrites."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def stamped(df: DataFrame, path: str) -> None:
    df.withColumn("generated_at", F.current_timestamp()).write.json(path)


def order_template(lines: DataFrame, page_key: str, path: str) -> None:
    """Each page's lines in their present order, for review."""
    order_template_rows(lines, page_key).write.json(path)


def order_template_rows(lines: DataFrame, page_key: str) -> DataFrame:
    sizes = lines.groupBy(page_key).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return sizes.select(page_key, F.sequence(F.lit(0), F.col("n") - 1).alias("order"))
