"""Filter interactions against a plain recount over all orders."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from folioworks.llm import filter_audit


def plain(rows, labels):
    """(part, order, step) to counts, row by row and order by order."""
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = {}
    judged = []
    for i, part, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and first[t] < i,
        }
        judged.append((part or "", {k for k, v in bad.items() if v}, any(q == 1 for d, q, _ in labels if d == i and i is not None), any(x == 1 for d, _, x in labels if d == i and i is not None)))
    for part in {p for p, *_ in judged}:
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                mine = [j[1:] for j in judged if j[0] == part]
                gone = [b & set(order[: step - 1]) for b, _, _ in mine]
                hit = [(b, g, x) for (b, g, x), e in zip(mine, gone) if f in b and not e]
                out[part, "".join(order), step] = [
                    sum(not b & set(order[:step]) for b, _, _ in mine), len(hit), sum(f in b and bool(e) for (b, _, _), e in zip(mine, gone)),
                    sum(b == {f} for b, _, _ in mine), sum(g for _, g, _ in hit), sum(x for _, _, x in hit),
                ]
                share[f] += len(hit)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(share[f])
    return out


def rows():
    rnd = random.Random(5)
    out = []
    for i in range(120):
        n = rnd.choice([0, 1, 150, 199, 200, 201, 260])
        t = rnd.choice([" ", "\n", "\x0b\t "]).join(rnd.choice(["das", "été", "Ab", "x\x85y", f"w{rnd.randint(0, 900)}", f"v{rnd.randint(0, 900)}"]) for _ in range(n))
        out.append((i, rnd.choice(["web", "news", None, ""]), t + rnd.choice(["", "", " #", "|", " "])))
    out += [(i + 200, "web", out[i][2]) for i in range(0, 60, 3)]
    out += [(300, "web", None), (301, None, ""), (None, "web", out[7][2]), (None, "news", "only here"), (302, "news", "only here"), (5, "web", out[5][2]), (303, "news", "Word " * 30_000)]
    return out


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 300, 2)] + [(4, 1, 1), (None, 1, 1), (9, None, None)]


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_plain_recount(spark, monkeypatch, small):
    if small:  # many slices, shards and common texts
        for name, value in (("SLICE_BYTES", 2_000), ("SHARD_WORDS", 1_500), ("COMMON_TEXT", 40)):
            monkeypatch.setattr(filter_audit, name, value)
    docs = spark.createDataFrame(rows(), "doc_id long, source string, text string").withColumn("part", F.lit(1)).withColumn("fails", F.lit("x")).withColumn("good", F.lit(2)).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("spread", F.lit(1))
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(docs, labels).collect()}
    assert got == plain(rows(), LABELS)


def test_terms_are_numbered_alike_in_all_shards(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SLICE_BYTES", 50)
    monkeypatch.setattr(filter_audit, "SHARD_WORDS", 20)
    texts = {i: " ".join(f"w{(i * k) % 7}" for k in range(i % 9)) for i in range(60)}
    docs = spark.createDataFrame([(i, "a", t) for i, t in texts.items()], "doc_id long, source string, text string").repartition(4)
    of, seen = {}, set()
    shards = filter_audit.term_shards(docs).collect()
    assert len({s["shard"] for s in shards}) > 4
    for s in shards:
        for k, i in enumerate(s["doc_id"]):
            cells = dict(zip(s["terms"][s["bounds"][k] : s["bounds"][k + 1]], s["counts"][s["bounds"][k] : s["bounds"][k + 1]]))
            words = texts[i].split()
            assert sorted(cells.values()) == sorted(words.count(w) for w in set(words))
            if len(set(words)) == 1:
                assert of.setdefault(words[0], next(iter(cells))) == next(iter(cells))
            seen |= set(cells)
    assert len(seen) == 7 and len(set(of.values())) == len(of)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
