"""Run events as streams. Every job has a batch twin; the rule for late events is the watermark given to it."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.distance import agreement_gate

LATE = "10 minutes"
#: Runs whose ids hash alike share a call and a row of state: a call costs milliseconds, whatever it holds.
BUCKETS = 4_096


def without_repeats(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each (run, seq) once; events later than the watermark are not recognised as repeats any more."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "seq"])


def _milliseconds(time: str) -> int:
    return int(pd.Timedelta(time).total_seconds() * 1000)


def by_run(events: DataFrame, step: Callable, schema: StructType, mode: str, idle: str) -> DataFrame:
    """State per run over ``events``, which have run_id, ts and a watermark.

    ``step(columns, places, held, out)`` gets the new rows of one run, as their places in lists by column, and what is held of the run
    (None at first). It adds the run's results to ``out``, tuples of ``schema``'s columns without run_id, and returns what is held
    from now on: values that JSON has, or None for nothing. Longs come as strings, so that nulls beside them cost no digits. ``_at``
    is the time in microseconds. A run is dropped once the watermark is ``idle`` past its newest event.
    """
    milliseconds = _milliseconds(idle)
    longs = [f.name for f in events.schema.fields if isinstance(f.dataType, LongType)]
    names = [*events.columns, "_at"]

    def bucket(key, batches, state):
        now = state.getCurrentWatermarkMs()
        runs = {run: (expires, held) for run, expires, held in json.loads(state.get[0])} if state.exists else {}
        batches, places, out = [] if state.hasTimedOut else [b for b in batches if len(b)], defaultdict(list), []
        if batches:
            rows = batches[0] if len(batches) == 1 else pd.concat(batches)
            columns = {name: rows[name].tolist() for name in names}
            for place, run in enumerate(columns["run_id"]):
                places[run].append(place)
        for run, mine in places.items():
            found: list[tuple] = []
            held = step(columns, mine, runs.pop(run, (0, None))[1], found)
            out += [(run, *row) for row in found]
            if held is not None:
                runs[run] = (max(max(columns["_at"][i] for i in mine) // 1000, now) + milliseconds, held)
        runs = {run: kept for run, kept in runs.items() if kept[0] >= now}
        if runs:
            state.update((json.dumps([(run, *kept) for run, kept in runs.items()]),))
            state.setTimeoutTimestamp(min(expires for expires, _ in runs.values()))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=wire.names)

    wire = StructType([StructField(f.name, StringType() if isinstance(f.dataType, LongType) else f.dataType) for f in schema.fields])
    rows = events.withColumns({"_bucket": F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)), "_at": F.coalesce(F.unix_micros("ts"), F.lit(-1 << 63)), **{c: F.col(c).cast("string") for c in longs}})
    found = rows.groupBy("_bucket").applyInPandasWithState(bucket, wire, "runs string", mode, GroupStateTimeout.EventTimeTimeout)
    return found.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def live_state(events: DataFrame, late: str = LATE, idle: str = "1 day", end_stage: str = "pipeline_done") -> DataFrame:
    """Latest status of each stage of each run, for update mode: a row per stage that the new events changed.

    A run's state is dropped at its end event, and once the watermark is ``idle`` past its last event. A row that comes after
    that starts anew; ``newest`` keeps the higher sequence number. Repeated and older events change nothing.
    """

    def step(columns, places, held, out):
        last, over = {}, False
        for i in places:
            stage, seq, status = columns["stage"][i], columns["seq"][i], columns["status"][i]
            over |= stage == end_stage
            rank = (seq is None, None if seq is None else int(seq))  # one without a number comes last
            before = last.get(stage)
            if before is None or rank[0] > before[0][0] or (rank[0] == before[0][0] and (rank[0] or rank[1] >= before[0][1])):
                last[stage] = (rank, status)
        known = {stage: (seq, status) for stage, seq, status in held or []}
        changed = {stage: (seq, status) for stage, ((_, seq), status) in last.items() if stage not in known or known[stage][0] is None or (seq is not None and seq > known[stage][0])}
        out += [(stage, None if seq is None else str(seq), status) for stage, (seq, status) in changed.items()]
        return None if over else [(stage, *row) for stage, row in {**known, **changed}.items()]

    rows = events.select("run_id", "stage", F.col("seq").cast("long").alias("seq"), "status", "ts").withWatermark("ts", late)
    return by_run(rows, step, StructType.fromDDL("run_id string, stage string, seq long, status string"), "update", idle)


def bursts(events: DataFrame, gap: str = "15 seconds", late: str = LATE) -> DataFrame:
    """Stretches of a run without a pause of ``gap``; the time between them is idle."""
    rows = events.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return rows.select("run_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def throughput(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Events and failures per time window, tumbling or sliding."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    rows = events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") == "failed").alias("failed"))
    return rows.select(F.col("w.start").alias("start"), "events", "failed")


def interrupted(events: DataFrame, timeout: str, late: str = LATE, end_stage: str = "pipeline_done") -> DataFrame:
    """Stretches of a run after which it fell silent for ``timeout``, given out once the watermark passes: failed without an
    end event, else ended. A run that goes on later gets another stretch; ``still_interrupted`` tells which runs stay failed."""
    rows = events.withWatermark("ts", late).groupBy("run_id", F.session_window("ts", timeout).alias("w")).agg(F.max(F.col("stage") == end_stage).alias("ended"), F.count(F.lit(1)).alias("events"))
    return rows.select("run_id", F.col("w.end").alias("closed_at"), F.when(F.col("ended"), "ended").otherwise("failed").alias("status"), "events")


def still_interrupted(stretches: DataFrame) -> DataFrame:
    """Of what ``interrupted`` gave out: the runs whose last stretch had no end and that no stretch ended before."""
    last = stretches.groupBy("run_id").agg(F.max_by("status", "closed_at").alias("status"), F.max("closed_at").alias("closed_at"), F.sum("events").alias("events"), F.max(F.col("status") == "ended").alias("over"))
    return last.filter("not over").select("run_id", "closed_at", "status", "events")


def complete_articles(pages: DataFrame, counts: DataFrame, late: str = LATE, idle: str = "1 day") -> DataFrame:
    """Runs all of whose pages have arrived, each once, as soon as its last page is there; ``counts`` (static) has run_id and page_count.

    A run's state is the set of its pages, and no more than a mark once it is complete; it is dropped when the watermark is
    ``idle`` past the run's last page, whether all pages came or not. Repeated pages count once, pages without a number not at all.
    """

    def step(columns, places, held, out):
        seen, complete = held or ([], False)
        if not complete:
            seen = list(dict.fromkeys([*seen, *(page for i in places if (page := columns["page"][i]) is not None)]))
            count = columns["page_count"][places[0]]
            complete = len(seen) >= int(count)
            if complete:
                out.append((count,))
        return [] if complete else seen, complete

    rows = pages.withWatermark("ts", late).join(counts.select("run_id", F.col("page_count").cast("long").alias("page_count")), "run_id").select("run_id", F.col("page").cast("string").alias("page"), "page_count", "ts")
    return by_run(rows, step, StructType.fromDDL("run_id string, page_count long"), "update", idle)


def gated(pairs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Each pair with its gate as it arrives."""
    return pairs.withColumn("gate", agreement_gate(F.col("a"), F.col("b"), threshold=threshold, composed=True))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now into Parquet. A batch that is run again overwrites its own part.

    In update mode later parts hold newer rows of the same keys, see ``newest``.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part_{number:09d}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def written(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/part_*")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key that an update-mode stream wrote."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    rank = F.struct("batch", *[c for c in ("seq",) if c in others])  # within a batch, the row of the higher sequence number
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), rank).alias("r"))
    return last.select(*keys, "r.*")
