"""Pairs made from plain conversations, with nulls, ties and repeated turns, against plain loops and against the SQL."""

import random

import duckdb
from pyspark.sql import functions as F

from folioworks.llm import chat_format
from folioworks.llm.queries import op7_chat_formatting

ROWS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "yo"), (1, 1, "assistant", "b"),
    (2, 0, "user", "alone"), (2, 1, "assistant", "end"),  # no neighbour
    (4, None, "system", "no number"), (4, 0, "user", "x"), (4, 1, "assistant", "y"), (5, None, None, None), (5, None, "user", "z"),
    (6, 0, "user", "q"), (6, 1, "assistant", "twice"), (6, 1, "assistant", "twice"), (7, 0, "user", "only"),
    (None, 0, "user", "lost"), (None, 1, "assistant", "found"), (None, None, None, "n"),
]


def order(turn):
    return (turn[0] is not None, turn[0] or 0, turn[1] or "", turn[2] or "")


def plain(rows):
    turns = {}
    for i, *turn in rows:
        turns.setdefault(i, []).append((turn[0], turn[1] or "", turn[2] or ""))
    ordered = {i: sorted(t, key=order) for i, t in turns.items()}
    out = []
    for i, c in ordered.items():
        r = c[:-1]
        if i is not None and i ^ 1 in ordered:
            r = sorted([*r, (c[-1][0], *ordered[i ^ 1][-1][1:])], key=order)
        same = 0
        while same < min(len(c), len(r)) and c[same][1:] == r[same][1:]:
            same += 1
        show = lambda ts: "".join(f"<|{role}|>\n{text}<|end|>\n" for _, role, text in ts)

        def mask(ts, k):
            spans, at = [], 0
            for n, (_, role, text) in enumerate(ts):
                at += len(role) + len(text) + 13
                if n >= k and role == "assistant":
                    spans.append(f"{at - len(text) - 8}-{at}")
            return ",".join(spans)

        out.append((i, same, show(c[:same]), show(c[same:]), show(r[same:]), mask(c, same), mask(r, same)))
    return sorted(out, key=repr)


def answers(spark, folder, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("last", F.lit(1)).withColumn("pair_id", F.lit("x")).repartition(2).write.parquet(f"{folder}/conversations.parquet")
    got = sorted((tuple(r) for r in op7_chat_formatting(spark, str(folder)).collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * EXCLUDE (pair_id) FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    return got, sorted(con.sql(chat_format.ORACLE).fetchall(), key=repr)


def test_nulls_ties_and_missing_neighbours(spark, tmp_path):
    got, sql = answers(spark, tmp_path, ROWS)
    assert got == plain(ROWS) and sql == plain(ROWS)
    by_id = {r[0]: r for r in got}
    assert by_id[6][1] == 2 and by_id[6][4] == "<|user|>\nonly<|end|>\n"  # one of the two equal last turns stays
    assert by_id[None][1] == 2 and by_id[None][4] == ""


def test_random_conversations(spark, tmp_path):
    rnd = random.Random(13)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, 0, 1, 2, 2, 3]), rnd.choice([None, "user", "assistant"]), rnd.choice([None, "", "a", "b", "long " * 50])) for _ in range(220)]
    got, sql = answers(spark, tmp_path, rows)
    assert got == plain(rows) and sql == plain(rows)
