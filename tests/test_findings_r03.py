"""Cases of the findings of round 3."""

from pyspark.sql import functions as F

from folioworks.functions.text import LATIN
from folioworks.operators import lexicon as L
from folioworks.operators import page_eval as P
from folioworks.plans import inputs, page_plans


def _lineitems(spark, path, rows):
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_a_part_number_of_equal_digits_is_no_repeat(spark, tmp_path):
    # (7 * page + 13 * line) % 100 >= 95: the predicted box is far off, so its line is extra, with the part number in it.
    path = _lineitems(spark, tmp_path, [(12, 11111, 1, "A", "F"), (12, 222, 2, "N", "O")])
    pred = inputs.predicted_lines(inputs.gold_lines(spark, path))
    assert [r["text"] for r in pred.filter("y1 > 2000").collect()] == ["lime 11111 F A"]
    found = {r["category"]: r["lines"] for r in page_plans.page_error_breakdown(spark, path).collect()}
    assert (found["extra_no_gold_overlap"], found["repeated_run"]) == (1, 1)  # the repeat is the second line's "aaaaaaaa"
    # the operator's own rule counts every character
    outcomes = P.line_outcomes(pred, inputs.gold_lines(spark, path), ["page_id"])
    assert outcomes.filter("repeats").count() == 2


def test_many_lookups_are_not_broadcast_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(L, "FREQUENT", 4)
    words = [(d, w, 1) for d in range(60) for w in ("of", f"w{d}", f"x{d % 7}")]
    rows = L._kept(spark.createDataFrame(words, "doc_id int, word string, n int"))
    resolved = L._kept(rows.select("word").distinct().filter("word <> 'x3'").withColumn("status", F.concat(F.lit("s"), "word")))
    out = L._attached(rows, resolved)
    got = sorted((r["doc_id"], r["word"], r["status"] or "") for r in out.collect())
    assert got == sorted((d, w, "" if w == "x3" else f"s{w}") for d, w, _ in words)
    # The files are far below Spark's own limit for broadcasts, but only tables of frequent words are broadcast: the one that finds
    # them, their lookups, and the words left out of the shuffle.
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan
    assert [r["word"] for r in out.filter("word = 'of'").select("word").distinct().collect()] == ["of"]


def test_a_round_of_matching_sorts_its_edges_three_times(spark, monkeypatch):
    plans, kept = [], P.kept
    monkeypatch.setattr(P, "kept", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, label))[1])
    box = "struct<idx:int,conf:double>"
    edges = spark.createDataFrame([(1, (0, 0.9), (0, None), 0.8), (1, (1, 0.5), (0, None), 0.9)], f"page_id int, p {box}, g {box}, iou double")
    assert [(r["p"]["idx"], r["g"]["idx"]) for r in P._matched(edges, ["page_id"]).collect()] == [(0, 0)]
    assert plans[0].count("Sort [") == 3


def test_coverage_of_more_words_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_ROWS", 2)
    docs = spark.createDataFrame([(1, "red of red zzz"), (2, None), (3, "of qqq-red")], "doc_id int, text string")
    lexicon = spark.createDataFrame([("red", "rot", 3, 1)], "jawi string, rumi string, n long, ord int")
    got = {r["doc_id"]: (r["word_count"], r["unknown_count"]) for r in L.document_coverage(docs, lexicon, LATIN, composed=True).collect()}
    assert got == {1: (4, 1), 2: (0, 0), 3: (2, 1)}
