"""Streams over growing logs: replay and follow, state that ends, late and repeated events."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.streaming import journal as J
from folioworks.streaming import runs as T

EVENT = "run_id string, seq long, ts timestamp, stage string, status string, page string"


def minute(m):
    return f"2024-05-01 {m // 60:02d}:{m % 60:02d}:00"


def event(run, seq, at, stage="ocr", status="completed", page=None):
    return {"run_id": run, "seq": seq, "ts": minute(at), "stage": stage, "status": status, "page": page}


class Log:
    """A folder of JSON lines that a stream follows."""

    def __init__(self, spark, path):
        self.spark, self.path, self.files = spark, path, 0
        path.mkdir()

    def add(self, *events):
        self.files += 1
        (self.path / f"{self.files:04d}.json").write_text("\n".join(map(json.dumps, events)))

    def stream(self):
        return self.spark.readStream.schema(EVENT).json(str(self.path))


def rows_of(spark, path):
    return sorted((r["run_id"], r["index"], r["seq"], r["stage"]) for r in T.written(spark, path).collect())


# --- replay, then follow


def test_late_readers_get_the_same_sequence(spark, tmp_path):
    log = Log(spark, tmp_path / "log")
    book, first, second, third = (f"{tmp_path}/{n}" for n in ("journal", "first", "second", "third"))
    grow = lambda: J.keep(J.numbered(log.stream()), book, f"{book}-state").awaitTermination()
    read = lambda out, **more: J.follow(spark, book, f"{out}-state", J.to_folder(out), **more).awaitTermination()
    log.add(event("a", 1, 0), event("b", 1, 0))
    grow()
    read(first)  # the first reader is there from the start
    log.add(event("a", 3, 2), event("a", 2, 1), event("a", 2, 1), event("b", 2, 1))
    grow()
    read(first)
    read(second)  # a reader that starts in the middle of both runs
    log.add(event("a", 2, 3), event("a", 5, 4), event("b", 1, 3), event("b", None, 4))  # repeats, a gap, an event without a number
    grow()
    read(second)
    log.add(event("a", 4, 5), event("a", 6, 6, "pipeline_done"), event("a", 7, 6), event("c", 9, 6))  # the gap is filled, one after the end
    grow()
    log.add(event("a", 8, 7), event("b", 3, 7, "pipeline_done"))
    grow()
    for out in (first, second):
        read(out)
    read(third)  # after the end of all
    want = [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("a", 3, 5), ("a", 4, 4), ("a", 5, 6), ("b", 0, 1), ("b", 1, 2), ("b", 2, None), ("b", 3, 3), ("c", 0, 9)]
    got = {out: sorted(((r["run_id"], r["index"], r["seq"]) for r in T.written(spark, out).collect()), key=lambda r: r[:2]) for out in (first, second, third)}
    assert got == dict.fromkeys((first, second, third), want)
    read(third)  # nothing new, nothing twice
    assert T.written(spark, third).count() == len(want)
    some = f"{tmp_path}/some"
    read(some, run_ids=["a"], since=4)
    assert [r[:3] for r in rows_of(spark, some)] == [("a", 4, 4), ("a", 5, 6)]


def test_a_part_without_its_marker_is_written_again(spark, tmp_path):
    log, book = Log(spark, tmp_path / "log"), f"{tmp_path}/journal"
    log.add(event("a", 1, 0))
    J.keep(J.numbered(log.stream()), book, f"{book}-state").awaitTermination()
    whole = sorted(map(tuple, J.replay(spark, book, J.ready(spark, book)).select("run_id", "index", "seq").collect()))
    # A crash after the part and before its marker: the batch is not committed and runs again over what half a part left.
    state = tmp_path / "journal-state"
    for folder, names in ((tmp_path / "journal" / "ready", "*"), (state / "commits", "*"), (state / "commits", ".*.crc"), (state / "offsets", "*1"), (state / "offsets", ".1.crc")):
        for gone in folder.glob(names):
            gone.unlink()
    assert J.ready(spark, book) == []
    J.keep(J.numbered(log.stream()), book, f"{book}-state").awaitTermination()
    assert sorted(map(tuple, J.replay(spark, book, J.ready(spark, book)).select("run_id", "index", "seq").collect())) == whole == [("a", 0, 1)]


def test_a_failed_replay_starts_again_at_the_same_place(spark, tmp_path):
    log, book, out = Log(spark, tmp_path / "log"), f"{tmp_path}/journal", f"{tmp_path}/out"
    grow = lambda: J.keep(J.numbered(log.stream()), book, f"{book}-state").awaitTermination()
    log.add(event("a", 1, 0))
    grow()

    def broken(rows, number):
        raise OSError("no space")

    with pytest.raises(OSError):
        J.follow(spark, book, f"{out}-state", broken)
    log.add(event("a", 2, 1))
    grow()
    J.follow(spark, book, f"{out}-state", J.to_folder(out)).awaitTermination()
    assert [r[1:3] for r in rows_of(spark, out)] == [(0, 1), (1, 2)]


def test_reader_of_an_empty_journal(spark, tmp_path):
    log, book, out = Log(spark, tmp_path / "log"), f"{tmp_path}/journal", f"{tmp_path}/out"
    log.add(event("a", 1, 0))
    (tmp_path / "journal" / "ready").mkdir(parents=True)
    J.follow(spark, book, f"{out}-state", J.to_folder(out)).awaitTermination()
    J.keep(J.numbered(log.stream()), book, f"{book}-state").awaitTermination()
    J.follow(spark, book, f"{out}-state", J.to_folder(out)).awaitTermination()
    assert [r[1:3] for r in rows_of(spark, out)] == [(0, 1)]


def test_ranges_of_seen_numbers_against_a_set():
    rnd = random.Random(2)
    for _ in range(200):
        seen, low, high = set(), [], []
        for _ in range(6):
            batch = sorted({rnd.randrange(40) for _ in range(rnd.randint(0, 12))})
            fresh, low, high = J.without_seen(np.array(batch, dtype=np.int64), low, high)
            assert fresh.tolist() == [x not in seen for x in batch]
            seen |= set(batch)
            assert {x for a, b in zip(low, high) for x in range(a, b + 1)} == seen
            assert all(b + 1 < c for b, c in zip(high, low[1:]))


# --- state that ends


def held(query):
    """State rows after the last batch."""
    return query.lastProgress["stateOperators"][-1]["numRowsTotal"]


def run(stream, path, mode="update"):
    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part_{number:09d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def test_live_state_ends_and_times_out(spark, tmp_path):
    log, out = Log(spark, tmp_path / "log"), f"{tmp_path}/out"
    stream = lambda: T.live_state(log.stream(), late="10 minutes", idle="30 minutes")
    log.add(event("a", 1, 0), event("a", 3, 2, "gate", "running"), event("a", 2, 1, "gate", "pending"), event("b", 1, 0), event("c", 1, 0, "pipeline_done"))
    assert held(run(stream(), out)) == 2  # c has ended at once
    log.add(event("a", 3, 3, "gate", "changed"), event("a", 2, 4, "gate", "older"), event("a", 5, 4, "gate", "completed"))
    run(stream(), out)
    now = {(r["run_id"], r["stage"]): (r["seq"], r["status"]) for r in T.newest(T.written(spark, out), ["run_id", "stage"]).collect()}
    assert now == {("a", "ocr"): (1, "completed"), ("a", "gate"): (5, "completed"), ("b", "ocr"): (1, "completed"), ("c", "pipeline_done"): (1, "completed")}
    log.add(event("a", 6, 5, "pipeline_done"))
    assert held(run(stream(), out)) == 1  # only b is open
    log.add(event("d", 1, 90, "pipeline_done"))  # the watermark passes b's last event by more than half an hour
    assert held(run(stream(), out)) == 0
    log.add(event("b", 2, 1, "ocr", "too late"), event("e", 1, 91, "pipeline_done"))  # behind the watermark
    run(stream(), out)
    assert T.newest(T.written(spark, out), ["run_id", "stage"]).filter("run_id = 'b'").head()["status"] == "completed"


def test_complete_articles_once_and_without_leftovers(spark, tmp_path):
    log, out = Log(spark, tmp_path / "log"), f"{tmp_path}/out"
    counts = spark.createDataFrame([("a", 2), ("b", 3), ("c", 1), ("d", 1)], "run_id string, page_count long")
    stream = lambda: T.complete_articles(log.stream(), counts, late="10 minutes", idle="30 minutes")
    page = lambda run, n, at: event(run, 0, at, page=n)
    log.add(page("a", "1", 0), page("a", "1", 0), page("a", None, 0), page("b", "1", 0), page("c", "7", 0), page("unknown", "1", 0))
    run(stream(), out)
    complete = lambda: sorted((r["run_id"], r["page_count"]) for r in T.written(spark, out).select("run_id", "page_count").collect())
    assert complete() == [("c", 1)]
    log.add(page("a", "2", 1), page("c", "7", 1), page("b", "2", 1))
    query = run(stream(), out)
    assert complete() == [("a", 2), ("c", 1)] and held(query) == 3
    log.add(page("a", "1", 2), page("d", "1", 90))  # a stays complete; d moves the watermark past all others
    run(stream(), out)
    log.add(page("d", "1", 200))
    assert held(run(stream(), out)) == 1
    assert complete() == [("a", 2), ("c", 1), ("d", 1)]  # b never got its third page and is gone


def test_journal_state_expires(spark, tmp_path):
    log, out = Log(spark, tmp_path / "log"), f"{tmp_path}/out"
    stream = lambda: J.numbered(log.stream(), late="10 minutes", idle="30 minutes")
    log.add(event("a", 1, 0), event("b", 1, 0, "pipeline_done"))
    assert held(run(stream(), out, "append")) == 2
    log.add(event("c", 1, 100))
    assert held(run(stream(), out, "append")) == 1
