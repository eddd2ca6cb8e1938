"""Corpus metrics over all turns, long ones too, against plain counting."""

import re
from collections import Counter

import pytest

from folioworks.plans import metrics_plans as P

WORDS = "The nation reads each weather station of the earth"


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("turns"))
    rows = [(i, 0, "user", " ".join(f"{WORDS} {k * (i + 3)}" for k in range(1 + 9 * (i % 3)))) for i in range(12)] + [(20, 1, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def pairs(rows):
    texts = [re.sub("[^ -~]", "", r["text"] or "") for r in rows]
    return [(t, t.replace("tion", "sion").replace("ea", "e").replace("th", "t")) for t in texts]


def test_letter_occurrences_are_those_of_all_turns(spark, long_dir):
    rows = pairs(spark.read.parquet(f"{long_dir}/conversations.parquet").collect())
    assert sum(len(a) >= 400 for a, _ in rows) >= 4
    want = Counter(c for a, _ in rows for c in a)
    got = {r["letter"]: r["occurrences"] for r in P.letter_errors(spark, long_dir).collect()}
    assert got == {c: want[c] for c in "aeht"}


def test_rouge_is_the_mean_over_all_turns(spark, long_dir):
    rows = pairs(spark.read.parquet(f"{long_dir}/conversations.parquet").collect())
    ones = []
    for a, b in rows:
        r, h = (re.findall("[a-z0-9]+", x.lower()) for x in (a, b))
        hit = sum((Counter(r) & Counter(h)).values())
        ones.append(2 * hit / (len(r) + len(h)) if hit else 0.0)
    got = P.rouge(spark, long_dir).first()
    assert got["pairs"] == len(rows)
    assert got["rouge1"] == pytest.approx(sum(ones) / len(rows), abs=1e-6)
