"""Severity of toxic text by cumulative-link ordinal regression on sparse word features.

One weight per feature is shared by all ordered thresholds: P(grade > k) = sigmoid(x . w - threshold_k). The expected
severity is the sum of these probabilities. x holds log(1 + count) of the features that the labelled sample shows to go
with toxicity: words, and beginnings of words, which catch inflected and compounded forms. Labels say only whether a row is toxic, so toxic rows are split in grades by how many such words they
have, at the terciles of the sample.

The model is fitted on at most ``sample_rows`` labelled rows, chosen by the hash of their id, with at most
``max_words`` features; every row is scored on its whole text.

Defined results: null and empty texts have severity 0 and are not toxic; without labelled rows of both kinds nothing is
toxic; labels that are null or belong to no row are ignored, and of labels that disagree on one id the toxic one counts;
repeated rows get equal scores; ties between features go to the word that sorts first; very long texts are scored whole;
an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import letters

SAMPLE_ROWS = 8_000
#: Lengths of the word beginnings that are features, marked by a leading sign that no word has.
STEMS = (4, 5, 6)
STEM = "^"
MAX_WORDS = 1_000
#: A word is a feature if its chi-squared reaches this and this share of the strongest word's.
LEAST_CHI2, LEAST_SHARE = 18.0, 0.03
GRADES = 3
#: P(grade > 0) from which a text counts as toxic; one telling word alone stays below it.
TOXIC_AT = 0.25


def features(words: Counter) -> Counter:
    """Words and beginnings of longer words, with counts."""
    found = Counter(words)
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                found[STEM + w[:k]] += n
    return found


class OrdinalModel:
    """Weights by word and ascending thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        words, hits = Counter(letters(text)), Counter()
        for w, n in words.items():
            if w in self.weights:
                hits[w] += n
            for k in STEMS:
                if len(w) > k and (stem := STEM + w[:k]) in self.weights:
                    hits[stem] += n
        score = sum(self.weights[f] * np.log1p(n) for f, n in sorted(hits.items()))
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -60, 60)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, steps: int = 2500, rate: float = 0.05, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model by Adam: those of the greatest likelihood of the rows' grades, where
    P(grade = k) = P(grade > k - 1) - P(grade > k). Thresholds stay in order as a start and positive gaps."""
    n, m = x.shape
    rows, times = np.unique(np.column_stack([x, grade]), axis=0, return_counts=True)  # most rows have no telling word and are alike
    x, grade = rows[:, :m], rows[:, m]
    gaps = np.zeros(grades)
    gaps[0] = 1.0
    params, first, second = np.r_[np.zeros(m), gaps], np.zeros(m + grades), np.zeros(m + grades)
    grade, share = grade.astype(np.int64), times / n
    each, lower, upper = np.arange(len(grade)), grade >= 1, grade < grades
    for step in range(1, steps + 1):
        w, g = params[:m], params[m:]
        thresholds = np.cumsum(np.r_[g[0], np.exp(g[1:])])
        above = np.ones((len(grade), grades + 2))  # P(grade > k) for k from -1, where it is 1, to the last, where it is 0
        above[:, 1:-1] = 1 / (1 + np.exp(np.clip(thresholds[None, :] - (x @ w)[:, None], -60, 60)))
        above[:, -1] = 0.0
        a, b = above[each, grade], above[each, grade + 1]
        likely = np.maximum(a - b, 1e-12)
        off = (a + b - 1) * share
        by_threshold = np.bincount(grade[lower] - 1, (a * (1 - a) / likely * share)[lower], grades) - np.bincount(grade[upper], (b * (1 - b) / likely * share)[upper], grades)
        tail = np.cumsum(by_threshold[::-1])[::-1]
        grad = np.r_[x.T @ off + l2 * w, tail[0], tail[1:] * np.exp(g[1:])]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        params = params - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params[:m], np.cumsum(np.r_[params[m], np.exp(params[m + 1 :])])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, toxic, key, words, counts) of a bounded sample: every word of each labelled text; texts of one id differ in key."""
    usable = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).alias("toxic")).filter("id is not null and toxic is not null")
    usable = usable.groupBy("id").agg(F.max("toxic").alias("toxic"))
    picked = usable.orderBy(F.xxhash64("id"), "id").limit(rows)

    def count(batches):
        for batch in batches:
            words = [sorted(features(Counter(letters(t))).items()) for t in batch.column(3).to_pylist()]
            names = pa.array([[w for w, _ in x] for x in words], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], names, pa.array([[n for _, n in x] for x in words], pa.list_(pa.int32()))], ["id", "toxic", "key", "words", "counts"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(picked), F.col("_id") == F.col("id")).select("id", "toxic", F.xxhash64("text").alias("key"), "text").distinct()  # at most ``rows`` rows are broadcast
    return joined.mapInArrow(count, "id long, toxic boolean, key long, words array<string>, counts array<int>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, max_words: int = MAX_WORDS) -> OrdinalModel:
    from .common import materialise

    sample = materialise(labelled_sample(docs, labels, id_col, text_col, label_col, sample_rows), "labelled")
    sizes = sample.agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    bad, good = sizes[0], sizes[1]
    if not bad or not good:
        return OrdinalModel({}, np.full(GRADES, 50.0))
    seen = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b"))
    n, a, b = float(bad + good), F.col("a"), F.col("b")
    chi2 = n * (a * (good - b) - b * (bad - a)) ** 2 / ((a + b) * (n - a - b) * float(bad) * float(good))
    telling = seen.filter(a * good > b * bad).withColumn("chi2", F.coalesce(F.when(a + b < n, chi2), F.lit(0.0))).filter(F.col("chi2") > LEAST_CHI2)
    ranked = telling.orderBy(F.desc("chi2"), "word").limit(max_words).collect()
    vocabulary = {r["word"]: i for i, r in enumerate(ranked) if r["chi2"] >= LEAST_SHARE * ranked[0]["chi2"]}
    if not vocabulary:
        return OrdinalModel({}, np.full(GRADES, 50.0))
    known = F.broadcast(sample.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string"))
    cells = sample.select("id", "key", F.explode(F.arrays_zip("words", "counts")).alias("c")).select("id", "key", F.col("c.words").alias("word"), F.col("c.counts").alias("n")).join(known, "word")
    rows = {(r["id"], r["key"]): (i, r["toxic"]) for i, r in enumerate(sample.select("id", "key", "toxic").orderBy("id", "key").collect())}  # those of the sample
    x = np.zeros((len(rows), len(vocabulary)))
    for r in cells.collect():
        x[rows[r["id"], r["key"]][0], vocabulary[r["word"]]] = r["n"]
    toxic = np.array([t for _, t in sorted(rows.values())])
    hits = x.sum(axis=1)
    edges = np.quantile(hits[toxic], [i / GRADES for i in range(1, GRADES)])
    grade = np.where(toxic, 1 + (hits[:, None] > edges[None, :]).sum(axis=1), 0)
    weights, thresholds = fit_ordinal(np.log1p(x), grade, GRADES)
    return OrdinalModel({w: float(weights[i]) for w, i in vocabulary.items()}, thresholds)


GRADED = "severity double, p_toxic double, toxic boolean"


def graded(model: OrdinalModel, docs: DataFrame, text: Column) -> Column:
    """A struct of severity (0 to the number of grades), p_toxic and toxic for each row of ``docs``; only the text goes to Python."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    @F.arrow_udf(GRADED)
    def grade(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = OrdinalModel(*held.value)
        for texts in batches:
            said = []
            for first in range(0, len(texts), 256):
                above = [own.above(t) if t else np.zeros(GRADES) for t in texts.slice(first, 256).to_pylist()]
                said += [(float(p.sum()), float(p[0]), bool(p[0] >= TOXIC_AT)) for p in above]
            columns = list(zip(*said)) or [(), (), ()]
            kinds = (pa.float64(), pa.float64(), pa.bool_())
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["severity", "p_toxic", "toxic"])

    return grade(text)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity, p_toxic and toxic of every row."""
    said = docs.select(F.col(id_col).alias("doc_id"), graded(model, docs, F.col(text_col)).alias("said"))
    return said.select("doc_id", "said.severity", "said.p_toxic", "said.toxic")
