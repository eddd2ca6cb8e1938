"""Queries that SQL cannot express, over their whole tables, against plain versions."""

import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from folioworks.operators import annotations as A
from folioworks.plans import metrics_plans as P


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_pairwise_similarity(spark, sf_dir, tmp_path):
    some = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("text", F.substring("text", 1, 300)).withColumn("text", F.when(F.col("conv_id") % 5 > 0, F.col("text")))
    some.write.parquet(f"{tmp_path}/conversations.parquet")
    items = {}
    for r in some.collect():
        items.setdefault(r["conv_id"] * 1000 + r["turn"] // 2, []).append((f"{r['role']}-{r['turn'] % 2}", r["text"]))
    want = {}
    for item, readings in items.items():
        for (m, a), (n, b) in combinations(sorted(readings, key=lambda x: x[0]), 2):
            if m < n:
                want[item, m, n] = 200 * _common(a, b) / (len(a) + len(b)) if a and b else 0.0
    got = {(r["item"], r["method_a"], r["method_b"]): r["similarity"] for r in P.pairwise_methods(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and any(want.values())
    assert all(got[k] == pytest.approx(want[k], abs=0.00501) for k in want)


def test_repeated_runs_and_latin_share(spark, tmp_path):
    texts = ["aaaaa", "aaaa", "x#####y", "######", "a\n\n\n\n\nb", "", None, "ÄÄÄÄÄ abc", "  .....", "ab" * 9, "éa" + "z" * 5, "z" * 40_000, "123"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in P.repeated_runs(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        runs = [m[0] for m in re.finditer(r"(?s)(.)\1{4,}", text or "")]
        letters = [c for c in text or "" if c.isalpha()]
        assert got[i]["repeats"] == any(r not in "#####" for r in runs), text
        assert got[i]["latin_share"] == pytest.approx(sum("a" <= c <= "z" for c in letters) / len(letters) if letters else 0.0, abs=1e-9)


def test_truth_column_of_sheets_without_one(spark):
    rows = [(1, r, c, v) for r in range(3) for c, v in enumerate(["abc", "ÉÉÉ", "abd é"])] + [(2, 1, 0, "abc"), (3, 1, 0, None), (3, 2, 0, " ")]
    cells = spark.createDataFrame(rows, "article_id long, row int, col int, value string")
    assert {r["article_id"]: r["truth_col"] for r in A.truth_column(cells, block="a-z", strict=False).collect()} == {1: 2, 2: None, 3: None}
    with pytest.raises(Exception, match="no column in the expected script"):
        A.truth_column(cells, block="a-z").collect()
