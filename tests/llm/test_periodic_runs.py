"""Runs on Re-Pair grammars against a plain search, and the query against a plain version of its whole contract."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import periodic_runs, queries


def plain_runs(words):
    """(start, stop, period), sorted by start and period."""
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def random_text(rnd, letters, pieces=6):
    out = []
    for _ in range(rnd.randint(0, pieces)):
        out += [rnd.randrange(letters) for _ in range(rnd.randint(1, 9))] * rnd.randint(1, 7)
    return out


def searched(texts):
    start, stop, period = periodic_runs.runs_of(np.array([x for t in texts for x in t], dtype=np.int64), np.array([len(t) for t in texts], dtype=np.int64))
    return list(zip(start.tolist(), stop.tolist(), period.tolist()))


def wanted(texts):
    out, off = [], 0
    for t in texts:
        out += [(a + off, b + off, q) for a, b, q in plain_runs(t)]
        off += len(t)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_runs_equal_a_plain_search(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        texts = [random_text(rnd, rnd.choice([1, 2, 3, 50])) for _ in range(rnd.randint(1, 8))]
        texts += texts[:1] if rnd.random() < 0.3 else [[]]
        assert searched(texts) == wanted(texts)


def test_special_texts():
    square_free = [0]
    for _ in range(6):  # no square, so no run
        square_free = [y for x in square_free for y in ((0, 1, 2), (0, 2), (1,))[x]]
    overlap_free = [0]
    for _ in range(11):
        overlap_free += [1 - x for x in overlap_free]
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 1000:
        fibonacci, before = fibonacci + before, fibonacci
    texts = [square_free, overlap_free, fibonacci, [7] * 5, [7] * 6, [7, 8] * 3 + [7], [7, 8] * 4, [1] * 997, [3, 3, 3, 3, 3, 3, 4] * 9, list(range(500)), list(range(100)) * 4, list(range(100)) * 4 + [0]]
    assert searched(texts) == wanted(texts)
    assert searched([square_free, overlap_free]) == []


def test_a_long_text_and_a_small_block_of_candidates(monkeypatch):
    rnd = random.Random(3)
    long = [rnd.randrange(5000) for _ in range(60_000)] + list(range(4000)) * 5 + [1, 2] * 30_000
    assert [r[2] for r in searched([long])] == [4000, 2]
    monkeypatch.setattr(periodic_runs, "TOGETHER", 50)
    texts = [random_text(rnd, 2, 12) for _ in range(30)]
    assert searched(texts) == wanted(texts)


def test_colliding_hashes_are_noticed(monkeypatch):
    rnd = random.Random(8)
    texts = [random_text(rnd, 3) for _ in range(40)]
    monkeypatch.setattr(periodic_runs.Extensions, "equal", lambda self, a, b, size: np.ones(len(a), dtype=bool))
    got, want = searched(texts), wanted(texts)
    bounds = np.cumsum([0, *map(len, texts)])
    touched = {int(np.searchsorted(bounds, a, "right")) for a, _, _ in got}
    assert touched and got == [r for r in want if int(np.searchsorted(bounds, r[0], "right")) in touched]


def test_grammar_gives_the_text_back():
    rnd = random.Random(4)
    texts = [random_text(rnd, 4, 20) for _ in range(20)]
    symbols = np.array([x for t in texts for x in t], dtype=np.int64)
    last = np.zeros(len(symbols), dtype=bool)
    last[np.cumsum([len(t) for t in texts if t]) - 1] = True
    (rule, position, first, size), at, ends = periodic_runs.repair(symbols, last)
    expansion = {}
    for r, p, f, s in zip(rule.tolist(), position.tolist(), first.tolist(), size.tolist()):
        assert expansion.setdefault(r, (f, symbols[p : p + s].tolist())) == (f, symbols[p : p + s].tolist())
        assert not last[p : p + s - 1].any()
    assert all((rule == r).sum() >= 2 for r in expansion)
    stop = np.concatenate([at[1:], [len(symbols)]])
    assert ends.sum() == last.sum() and last[stop[ends] - 1].all()


def test_repeats_leave_little():
    """A pair that occurs twice gets a rule, so 64 repeats of a text without a pair twice end as one symbol."""
    symbols, last = np.tile(np.arange(50), 64), np.zeros(3200, dtype=bool)
    last[-1] = True
    (rule, _, _, size), at, _ = periodic_runs.repair(symbols, last)
    assert len(at) <= 4 and size.max() >= 1600 and len(np.unique(rule)) < 80


def contract(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    gone = {k for s, e, q in runs for k in range(s + q, e)}
    best = max(runs, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lead = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (i, len(runs), *lead, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_query_equals_its_contract(spark, tmp_path):
    rnd = random.Random(11)
    rows = [(i, " ".join(f"w{x}" if x else "é\x85" for x in random_text(rnd, rnd.choice([2, 40]))) + rnd.choice(["", "\n", " \x0b"])) for i in range(400)]
    rows += [(None, "a " * 9), (400, None), (401, ""), (402, " \t\n"), (7, rows[7][1]), (7, rows[7][1]), (403, "ha " * 20_000), (404, "one word")]
    names = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("runs", "n", "g", "leading", "n_words", "collapsed")})
    names.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    slow = {403}
    assert [r for r in got if r[0] not in slow] == sorted((contract(i, t) for i, t in rows if i not in slow), key=repr)
    assert [r[1:6] for r in got if r[0] in slow] == [(1, 0, 20_000, 1, 20_000_000)]


def test_empty_table(spark):
    assert periodic_runs.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0
