"""Run records: stage outcomes, run status, event logs, OCR stage summaries, routing and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import GATE_STAGE_STATUS, TERMINAL, is_empty

INCOMPLETE = ("failed", "failed_exception", "failed_timeout", "failed_empty_output", "running", "incomplete")
GATE_STAGE, RUN_ERROR = "agreement_gate", "error"


def latest_stage_states(events: DataFrame) -> DataFrame:
    """(run_id, stage, seq, status, duration) of the last event of each stage."""
    last = events.groupBy("run_id", "stage").agg(F.max(F.struct("seq", "status", "duration")).alias("e"))
    return last.select("run_id", "stage", "e.*")


def run_status(stages: DataFrame, gate: str = GATE_STAGE, error: str = RUN_ERROR) -> DataFrame:
    """Per run: failed if the run itself broke off (an ``error`` stage), needs_review if a stage is incomplete (failed or never
    ended) or the gate was flagged, skipped or asks for review, else completed."""
    broken = F.col("stage") == error
    bad = F.col("status").isin(*INCOMPLETE) & ~broken
    asks = (F.col("stage") == gate) & F.col("status").isin("flagged", "skipped", "needs_review")
    rows = stages.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("stages"), F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("stage")))), ",").alias("incomplete_stages"), F.count_if(bad).alias("n_bad"), F.max(broken).alias("broken"), F.max(asks).alias("review"), F.round(F.sum("duration"), 6).alias("duration")
    )
    status = F.when(F.col("broken"), "failed").when((F.col("n_bad") > 0) | F.col("review"), "needs_review").otherwise("completed")
    return rows.select("run_id", "stages", status.alias("status"), "incomplete_stages", (status != "completed").alias("needs_human_review"), "duration")


def stage_times(stages: DataFrame) -> DataFrame:
    """Per stage: runs, mean, median and longest duration, and attempts where the records have them."""
    tried = [F.sum("attempts").alias("attempts")] if "attempts" in stages.columns else []
    return stages.groupBy("stage").agg(*tried, F.count(F.lit(1)).alias("runs"), F.round(F.avg("duration"), 6).alias("mean"), F.round(F.percentile("duration", F.lit(0.5)), 6).alias("median"), F.round(F.max("duration"), 6).alias("longest"))


def numbered_events(events: DataFrame, since: int = 0) -> DataFrame:
    """Events with their index in the run, from ``since`` on; the same for every reader."""
    w = Window.partitionBy("run_id").orderBy("seq")
    return events.withColumn("idx", F.row_number().over(w) - 1).filter(F.col("idx") >= since)


def hot_runs(runs: DataFrame, keep: int = 50) -> DataFrame:
    """The finished runs to keep at hand: the newest ones."""
    return runs.filter(F.col("status").isin(*TERMINAL)).orderBy(F.desc("created_at"), F.desc("run_id")).limit(keep)


def interrupted_runs(events: DataFrame, now, timeout: str) -> DataFrame:
    """Runs without an end event whose last event is older than the timeout at ``now``; they count as failed."""
    last = events.groupBy("run_id").agg(F.max("ts").alias("last"), F.max(F.col("stage") == "pipeline_done").alias("ended"))
    return last.filter(~F.col("ended") & (F.col("last") < now - F.expr(f"interval {timeout}"))).select("run_id", "last", F.lit("failed").alias("status"))


def ocr_page_summary(lines: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per (run, page) and per run (page null): lines, mean confidence over lines that have one, low-confidence lines."""
    low = F.col("confidence") < threshold
    return lines.rollup("run_id", "page").agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(low).alias("low_lines")).filter("run_id is not null")


def ocr_run_summary(pages: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``ocr_page_summary`` from page records (run_id, page, status, lines), so that pages without lines count: per (run, page) and per run
    (page null) its pages, failed pages and lines, the mean confidence over lines that have one, and low-confidence lines."""
    lines = pages.select("run_id", "page", F.coalesce(F.startswith("status", F.lit("failed")), F.lit(False)).alias("bad"), F.explode_outer("lines").alias("line"))
    distinct = lambda c: F.countDistinct(c)  # noqa: E731  a page's row is repeated for each of its lines
    return lines.rollup("run_id", "page").agg(
        distinct(F.col("page")).alias("pages"), distinct(F.when(F.col("bad"), F.col("page"))).alias("failed_pages"), F.count("line").alias("lines"),
        F.round(F.avg("line.confidence"), 6).alias("mean_confidence"), F.count_if(F.col("line.confidence") < threshold).alias("low_lines"),
    ).filter("run_id is not null")


#: Lines that are joined at a time.
PIECE = 1_000


def article_text(lines: DataFrame) -> DataFrame:
    """Non-empty page texts of a run joined in page order, lines in order, by one line end each.

    Spark sorts the rows; arrays are of a piece's numbered lines, of a page's pieces and of a run's pages, never of all lines.
    """
    page = ["run_id", "page"]
    numbered = lines.filter("text <> ''").select(*page, "text", F.row_number().over(Window.partitionBy(*page).orderBy("ord", "text")).alias("k"))
    pieces = _joined_texts(numbered.withColumn("piece", F.floor(F.col("k") / PIECE)), [*page, "piece"], "k")
    return _joined_texts(_joined_texts(pieces, page, "piece"), ["run_id"], "page")


def _joined_texts(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(order, "text")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))


def stage_outcome(output, error, timed_out):
    """Status of one stage call from its output column, error column and timeout flag."""
    return F.when(timed_out, "failed_timeout").when(error.isNotNull(), "failed_exception").when(is_empty(output), "failed_empty_output").otherwise("completed")


NO_GATE = "Gate skipped because at least one romanisation method failed."


def gate_or_skipped(gate):
    """The gate of a romanisation, or a skipped one where a method failed and there is none: struct<status, reason, needs_review>.
    A gate that is missing or has not passed asks for a review."""
    return F.struct(F.coalesce(gate["status"], F.lit("skipped")).alias("status"), F.coalesce(gate["reason"], F.lit(NO_GATE)).alias("reason"), (~F.coalesce(gate["passed"], F.lit(False))).alias("needs_review"))


def gate_stage_status(gate):
    out = F.lit("pending")
    for name, status in GATE_STAGE_STATUS.items():
        out = F.when(gate == name, status).otherwise(out)
    return out


def unmatched_references(outputs: DataFrame, golds: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(outputs with their reference, references without an output)."""
    return outputs.join(golds, keys), golds.join(outputs, keys, "left_anti")


def write_once(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` that may be appended: keys that are not stored yet, each once."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
