"""Bit vectors against plain tables, and on long texts in time and memory."""

import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from folioworks.functions import bitvectors as B
from folioworks.functions import distance as D
from folioworks.operators import metrics as M


def table(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        rows.append([i])
        for j, y in enumerate(b, 1):
            rows[i].append(min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (x != y)))
    return rows


def plain_errors(ref, hyp):
    t, out, i, j = table(ref, hyp), [], len(ref), len(hyp)
    while i > 0:
        if j > 0 and t[i][j] == t[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            if ref[i - 1] != hyp[j - 1]:
                out.append(ref[i - 1])
            i, j = i - 1, j - 1
        elif t[i][j] == t[i - 1][j] + 1:
            out.append(ref[i - 1])
            i -= 1
        else:
            j -= 1
    return out[::-1]


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def some_pairs(n, seed=1):
    rnd = random.Random(seed)
    for _ in range(n):
        letters = rnd.choice(["ab", "abcé", "abcdefghijklmnopقرس𝒳"])
        a = "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 5, 17, 64, 65, 90])))
        b = "".join(c if rnd.random() > 0.3 else rnd.choice(["", rnd.choice(letters) * 2]) for c in a) if rnd.random() < 0.6 else "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 70)))
        yield a, b


def test_distances_scripts_and_subsequences_equal_plain_tables():
    for a, b in some_pairs(400):
        assert B.distance(a, b) == table(a, b)[-1][-1]
        assert B.source_errors(a, b) == plain_errors(a, b)
        assert B.common_subsequence(a, b) == plain_subsequence(a, b)
        words = [x.split("a") for x in (a, b)]
        assert B.common_subsequence(*words) == plain_subsequence(*words)
        assert B.distance(*words) == table(*words)[-1][-1]


def test_often_met_elements(monkeypatch):
    monkeypatch.setattr(B, "OFTEN", 0)
    for a, b in some_pairs(60, 2):
        assert B.common_subsequence(a, b) == plain_subsequence(a, b) and B.distance(a, b) == table(a, b)[-1][-1]


def changed(rnd, text, share):
    return "".join(c if rnd.random() > share else rnd.choice(["", "z", c + "z"]) for c in text)


def test_long_texts_in_time_and_memory():
    rnd = random.Random(9)
    text = "".join(rnd.choice("abcdefghij klmnop") for _ in range(50_000))
    other = changed(rnd, text, 0.1)
    began = time.process_time()
    assert 0 < B.distance(text, other) <= 6000
    assert B.common_subsequence(text, other) >= 44_000
    words = [[str(rnd.randrange(20_000)) for _ in range(50_000)] for _ in range(2)]
    assert B.common_subsequence(*words) < 5000
    assert time.process_time() - began < 20
    tracemalloc.start()
    errors = B.source_errors(text, other)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 2000 < len(errors) < 6000 and peak < 50 << 20


def test_columns_over_rows(spark):
    rnd = random.Random(4)
    rows = [(i, a, b) for i, (a, b) in enumerate(some_pairs(150, 3))] + [(200, None, "ab"), (201, None, None), (202, "x", None)]
    long = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    rows += [(203, long, long[::-1]), (204, long, changed(rnd, long, 0.02)), (205, "ab" * 500, "")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r["id"]: r["m"] for r in df.select("id", D.measured(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))).alias("m")).collect()}
    for i, a, b in rows:
        a, b = a or "", b or ""
        assert (got[i]["edits"], got[i]["a_chars"], got[i]["b_chars"]) == (B.distance(a, b), len(a), len(b)), i
    nothing = df.filter("id = 202").select(D.measured(F.col("a"), F.col("b")).alias("m")).head()["m"]
    assert nothing["edits"] is None
    cer = {r["id"]: r["c"] for r in df.select("id", D.compute_cer(F.col("a"), F.col("b")).alias("c")).collect()}
    assert cer[200] == 1.0 and cer[201] == 0.0 and cer[202] == 1.0 and cer[203] == round(B.distance(long, long[::-1]) / 3000, 4)
    total = M.corpus_cer(df.select(F.col("a").alias("ref"), F.col("b").alias("hyp"))).head()
    assert total["edits"] == sum(B.distance(a or "", b or "") for _, a, b in rows)


def test_far_pairs_alone_leave_the_jvm(spark):
    """Near pairs are settled by the bounded distance: the Python side gets nulls for their texts."""
    plan = spark.range(5).select(D.measured(F.concat(F.lit("abc"), "id"), F.lit("abcd")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein") == 1 and plan.count("_settled") == 1
