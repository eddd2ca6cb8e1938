"""Chunks that many media share, features of media, and fit and scores of toxicity, each against a plain version."""

import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioworks.llm import media_chunks, toxicity
from folioworks.llm.language_id import letters


def test_references_of_a_frequent_chunk_meet_it_in_several_places(spark, monkeypatch):
    monkeypatch.setattr(media_chunks, "PER_PLACE", 10)
    rows = [(bytes([i % 256, i // 256]), s, b"often" if s == 0 else f"rare{i}".encode()) for i in range(300) for s in range(2)]
    rows += [(b"twice", 0, b"often"), (b"twice", 1, b"often"), (b"lost", 0, b"nowhere")]
    references = spark.createDataFrame(rows, "medium binary, seq int, digest binary")
    stored = [(d, b"data of " + d) for d in {d for _, _, d in rows} - {b"nowhere"}]
    monkeypatch.setattr(media_chunks, "COUNTERS", 64)
    out = media_chunks.with_chunks(references, spark.createDataFrame(stored, "digest binary, data binary"))
    assert out.columns == ["medium", "seq", "digest", "data"]
    found = Counter((bytes(r["medium"]), r["seq"], bytes(r["digest"]), bytes(r["data"])) for r in out.collect())
    assert found == Counter((m, s, d, b"data of " + d) for m, s, d in rows if d != b"nowhere")


def test_media_that_share_most_chunks_read_back(spark, monkeypatch):
    monkeypatch.setattr(media_chunks, "PER_PLACE", 3)
    shared = "".join(chr(33 + b % 90) for b in np.random.default_rng(8).integers(0, 256, 90_000).tolist())
    rows = [(i, shared + str(i)) for i in range(40)] + [(41, shared), (41, shared), (42, None)]
    out = media_chunks.media_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    text = dict(rows)
    for r in out:
        raw = (text[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        centred = [b - 128 for b in payload]
        mean, rms = sum(centred) / len(centred), math.sqrt(sum(c * c for c in centred) / len(centred))
        crossings = sum((a < 0) != (b < 0) for a, b in zip(centred, centred[1:]))
        assert r["feature"] == f"mean={mean:.4f};rms={rms:.4f};crossings={crossings}"


def _loss(x, grade, grades, w, t, l2):
    """Minus the log likelihood of the grades, row by row: that of one grade is the difference of the chances to be above it and the one before."""
    total = 0.0
    for row, g in zip(x, grade):
        s = sum(a * b for a, b in zip(row, w))
        above = [1.0, *(1 / (1 + math.exp(k - s)) for k in t), 0.0]
        total -= math.log(above[g] - above[g + 1])
    return total / len(x) + l2 / 2 * sum(a * a for a in w)


def test_fit_is_where_the_loss_is_least():
    rng = np.random.default_rng(9)
    x = rng.poisson(0.8, (240, 4)).astype(float)
    grade = np.digitize(x @ [1.0, 0.5, 0.0, -0.5] + rng.logistic(0, 1, 240), [0.5, 1.5, 2.5])
    w, t = toxicity.fit_ordinal(x, grade, 3, l2=1e-3)
    least = _loss(x, grade, 3, w, t, 1e-3)
    for i in range(4):
        for step in (-0.05, 0.05):
            moved = np.array(w)
            moved[i] += step
            assert _loss(x, grade, 3, moved, t, 1e-3) > least
    for k in range(3):
        for step in (-0.05, 0.05):
            moved = np.array(t)
            moved[k] += step
            assert _loss(x, grade, 3, w, moved, 1e-3) > least


def test_scores_equal_a_plain_version(spark):
    weights, thresholds = {"vile": 1.5, "^vile": 0.25, "^awfu": 0.75, "bad": 1.0}, np.array([1.0, 2.0, 4.0])
    rows = [(1, "Vile, vile things"), (2, "vileness is awfully awful"), (3, "a bad day"), (4, ""), (5, None), (6, "vile " * 20_000), (6, "vile " * 20_000)]
    model = toxicity.OrdinalModel(weights, thresholds)
    out = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("x")), model).collect()}
    for key, text in rows:
        counts = Counter()
        for word in letters(text or ""):
            for name in [word, *("^" + word[:k] for k in (4, 5, 6) if len(word) > k)]:
                counts[name] += 1
        s = sum(weights[name] * math.log(1 + n) for name, n in counts.items() if name in weights)
        above = [1 / (1 + math.exp(t - s)) if text else 0.0 for t in thresholds]
        assert math.isclose(out[key]["severity"], sum(above), rel_tol=1e-12) and math.isclose(out[key]["p_toxic"], above[0], rel_tol=1e-12)
        assert out[key]["toxic"] == (above[0] >= toxicity.TOXIC_AT)
