"""A case of the findings of round 3 on the driver's memory."""

import re

from folioworks.functions.text import LATIN
from folioworks.operators import lexicon as L


def test_coverage_broadcasts_no_table_with_a_row_per_word(spark, monkeypatch):
    plans, kept = [], L.kept
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(L, "kept", lambda df, label: (plans.append(plan(df)), kept(df, label))[1])
    monkeypatch.setattr(L, "BROADCAST_ROWS", 2)
    docs = spark.createDataFrame([(1, "red of red zzz rered"), (2, None), (3, "of qqq-red")], "doc_id int, text string")
    lexicon = spark.createDataFrame([("red", "rot", 3, 1)], "jawi string, rumi string, n long, ord int")
    plans.append(plan(L.document_coverage(docs, lexicon, LATIN, composed=True)))
    # words, their rests after a prefix and their parts meet their lookups in shuffles; skeletons are the lexicon's, which is bounded
    joined = [set(re.findall(kind + r" \[(\w+)#", "\n".join(plans))) for kind in ("BroadcastHashJoin", "SortMergeJoin")]
    assert not joined[0] & {"key", "rest", "part"}
    assert {"key", "rest", "part", "word"} <= joined[1]


def test_a_large_lexicon_and_its_skeletons_are_not_broadcast(spark, monkeypatch):
    plans, kept = [], L.kept
    monkeypatch.setattr(L, "kept", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, label))[1])
    words = spark.createDataFrame([(w,) for w in ("red", "reed", "phone", "rephone", "zzz", "blue-red")], "word string")
    lexicon = spark.createDataFrame([("red", "rot", 3, 1), ("fone", "fon", 1, 1), ("blue", "blau", 2, 1)], "jawi string, rumi string, n long, ord int")
    joined = lambda kind: set(re.findall(kind + r" \[(\w+)#", "\n".join(plans)))
    want = {("red", "rot", "exact"), ("reed", "rot", "consonant_skeleton"), ("phone", "fon", "ph_to_f"), ("rephone", "again fon", "prefix_split+ph_to_f"), ("zzz", None, None), ("blue-red", "blau-rot", "hyphen_split")}
    found = lambda: {(r["word"], r["rumi"], r["rule"]) for r in L.resolve_words(words, lexicon, LATIN).collect()}
    # three rows, of which Spark broadcasts what it takes for small
    assert found() == want and {"variant", "skeleton"} <= joined("BroadcastHashJoin")
    plans.clear()
    monkeypatch.setattr(L, "BROADCAST_ROWS", 2)
    assert found() == want
    assert not joined("BroadcastHashJoin") & {"variant", "skeleton"} and {"variant", "skeleton"} <= joined("SortMergeJoin")
