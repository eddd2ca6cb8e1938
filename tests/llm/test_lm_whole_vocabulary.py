"""LM scores over many words and chunks, against plain counting of every word and bigram."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from folioworks.llm import lm_score


@pytest.mark.parametrize("size", [8 << 20, 1_000])
def test_every_word_and_bigram_has_its_own_count(spark, monkeypatch, size):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", size)
    monkeypatch.setattr(lm_score, "OFTEN", 2)  # the id 502 is one that very many share
    rnd = random.Random(5)
    rows = [(i, " ".join(f"w{int(6000 * rnd.random() ** 2)}" for _ in range(rnd.randint(1, 80)))) for i in range(400)]
    rows += [(500, "Rare rare pair"), (501, "rare pair"), (502, "rare"), (502, "rare"), (None, "rare w1"), (None, "rare w1"), (None, "pair"), (503, None), (504, "w1 w2 w1 w2 rare")]
    target = {*range(0, 400, 3), 501, 504}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm_score.cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()

    split = [(i, (t or "").lower().split()) for i, t in rows]
    vocabulary = {w for _, ws in split for w in ws}
    assert len(vocabulary) > lm_score.SIZE
    losses = []
    for chosen in ([ws for i, ws in split if i in target], [ws for _, ws in split]):
        pairs = Counter(p for ws in chosen for p in zip([None, *ws], ws))
        words, contexts = Counter(), Counter()
        for (v, w), n in pairs.items():
            words[w] += n
            contexts[v] += n
        total = sum(words.values()) + 0.5 * len(vocabulary)
        losses.append(lambda v, w, p=pairs, u=words, c=contexts, total=total: -math.log2((p[v, w] + lm_score.KAPPA * (u[w] + 0.5) / total) / (c[v] + lm_score.KAPPA)))
    want = []
    for i, ws in split:
        means = [sum(f(v, w) for v, w in zip([None, *ws], ws)) / len(ws) if ws else None for f in losses]
        want.append((i, len(ws), *means))
    order = lambda x: tuple(-1 if y is None else round(y, 3) for y in x)
    found = sorted(((r["doc_id"], r["n_tokens"], r["loss_target"], r["loss_background"]) for r in got), key=order)
    assert len(found) == len(want)
    for a, b in zip(found, sorted(want, key=order)):
        assert a[:2] == b[:2]
        assert a[2:] == (None, None) if b[2] is None else a[2:] == pytest.approx(b[2:], abs=1e-4)


def test_packed_numbers_come_back():
    for values in ([], [0], [1, 0, 255, 256], [2**63 + 5, 1], list(range(100_000))):
        assert lm_score.unpacked(lm_score.packed(np.array(values, dtype=np.uint64))).tolist() == values
