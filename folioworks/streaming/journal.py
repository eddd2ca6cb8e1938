"""Replay, then follow: every reader of a run gets the same sequence of events, whenever it starts.

``keep`` turns a stream of events into a journal. State per run gives each event its index, so the order that one reader saw is
the order of all. A micro-batch becomes a part below ``parts``; a marker below ``ready`` names it once it is whole, and a part that
has its marker is never written again. ``follow`` hands a reader over from one to the other: what the markers name at its start
is replayed in one bounded read, the last of their numbers is stored beside the checkpoint, and a stream of the markers gives the
parts after it. A reader that is started again goes on where it stopped, so nothing is lost and nothing comes twice.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from .runs import LATE, by_run

INDEX = "index"


def without_seen(seq: np.ndarray, low: list[int], high: list[int]) -> tuple[np.ndarray, list[int], list[int]]:
    """(which of the sorted distinct numbers are in none of the ranges ``low`` to ``high``, the ranges with them).

    Numbers without gaps are one range, however many they are."""
    lows, highs = np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)
    at = np.searchsorted(lows, seq, "right") - 1
    fresh = (at < 0) | (seq > highs[np.maximum(at, 0)]) if len(lows) else np.ones(len(seq), dtype=bool)
    starts = np.concatenate([lows, seq[fresh]])
    order = np.argsort(starts)
    starts, ends = starts[order], np.concatenate([highs, seq[fresh]])[order]
    gap = np.concatenate([[True], starts[1:] > ends[:-1] + 1]) if len(starts) else np.zeros(0, dtype=bool)
    return fresh, starts[gap].tolist(), ends[np.append(gap[1:], True)].tolist() if len(starts) else []


def numbered(events: DataFrame, late: str = LATE, idle: str = "1 day", end_stage: str = "pipeline_done") -> DataFrame:
    """The events of each run with their index from 0: in order of arrival, those of one micro-batch by ``seq``.

    An event whose ``seq`` the run had before is a repeat and goes; an event without one always counts. Nothing of a run comes
    after its end event, so a run ends once. A run's state is a counter and the ranges of the numbers it had; it is dropped when the
    watermark is ``idle`` past the run's last event, and events later than that would start a new run.
    """
    names = [f.name for f in events.schema.fields]

    def step(columns, places, held, out):
        count, low, high, over = held or (0, [], [], False)
        if over:
            return held
        seqs, times = columns["seq"], columns["_at"]
        order = sorted(places, key=lambda i: (seqs[i] is None, int(seqs[i] or 0), times[i]))  # those without a number last
        numbers = list(dict.fromkeys(int(seqs[i]) for i in order if seqs[i] is not None))
        fresh, low, high = without_seen(np.array(numbers, dtype=np.int64), low, high)
        left = {n for n, new in zip(numbers, fresh.tolist()) if new}
        for i in order:
            if seqs[i] is not None:
                if int(seqs[i]) not in left:
                    continue
                left.remove(int(seqs[i]))
            out.append((*(columns[name][i] for name in names if name != "run_id"), str(count)))
            count += 1
            if columns["stage"][i] == end_stage:
                return count, [], [], True
        return count, low, high, False

    rows = events.select("run_id", *[c for c in names if c != "run_id"])
    schema = StructType([*rows.schema.fields]).add(INDEX, LongType())
    return by_run(rows.withWatermark("ts", late), step, schema, "append", idle).select(*names, INDEX)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _mark(spark: SparkSession, folder: str, number: int) -> None:
    """A marker is one file that appears at once: it is written elsewhere and renamed."""
    Path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    hidden, place = Path(f"{folder}/.{number:09d}"), Path(f"{folder}/{number:09d}")
    files = place.getFileSystem(conf)
    out = files.create(hidden, True)
    out.write(bytearray(f"{number}\n".encode()))
    out.close()
    files.rename(hidden, place)


def _part(path: str, number: int) -> str:
    return f"{path}/parts/{number:09d}"


def _start(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], trigger: dict, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(write).start()


def keep(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts writing the journal of numbered events; ``trigger`` as of Spark, by default all there is now."""
    spark = events.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ready")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)

    def write(batch: DataFrame, number: int) -> None:
        if not _exists(spark, f"{path}/ready/{number:09d}"):
            batch.write.mode("overwrite").parquet(_part(path, number))
            _mark(spark, f"{path}/ready", number)

    return _start(events, checkpoint, write, trigger or {"availableNow": True})


def ready(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the parts that are whole: one per micro-batch of the journal."""
    if not _exists(spark, f"{path}/ready"):
        return []
    return sorted(int(r["value"]) for r in spark.read.text(f"{path}/ready").collect())


def replay(spark: SparkSession, path: str, parts: list[int], run_ids: list[str] | None = None, since: int = 0) -> DataFrame:
    """The events of these parts from index ``since`` on, of all runs or of some."""
    rows = spark.read.parquet(*(_part(path, n) for n in parts)).filter(F.col(INDEX) >= since)
    return rows if run_ids is None else rows.filter(F.col("run_id").isin(run_ids))


def follow(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], run_ids: list[str] | None = None, since: int = 0, **trigger) -> StreamingQuery:
    """Replays what the journal holds and follows it: ``sink(rows, number)`` gets part 0 from the replay and one part per
    micro-batch after it. A part that is given again, after a failure, has the same number and rows."""
    chosen, done = f"{checkpoint}-handover", f"{checkpoint}-replayed"
    if not _exists(spark, f"{chosen}/_SUCCESS"):
        parts = ready(spark, path)
        spark.createDataFrame([(parts[-1] if parts else -1,)], "last long").coalesce(1).write.mode("overwrite").parquet(chosen)
    last = spark.read.parquet(chosen).head()["last"]
    if not _exists(spark, f"{done}/_SUCCESS"):
        if parts := [n for n in ready(spark, path) if n <= last]:
            sink(replay(spark, path, parts, run_ids, since), 0)
        spark.createDataFrame([(last,)], "last long").coalesce(1).write.mode("overwrite").parquet(done)

    def write(batch: DataFrame, number: int) -> None:
        if parts := sorted(int(r["value"]) for r in batch.collect() if int(r["value"]) > last):
            sink(replay(spark, path, parts, run_ids, since), number + 1)

    # A reader that was away for long still gets every marker.
    markers = spark.readStream.schema("value string").option("maxFileAge", "3650d").text(f"{path}/ready")
    return _start(markers, checkpoint, write, trigger or {"availableNow": True})


def to_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps each part in a folder of its own; a part that comes again replaces itself."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/part_{number:09d}")
