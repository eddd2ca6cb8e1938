"""Matching in rounds and rank agreement by levels, against loops over single pages."""

import random

from pyspark.sql import functions as F

from folioworks.operators import page_eval as P

PAGE = ["page_id"]
BOX = "struct<idx:int,conf:double>"


def greedy(edges):
    """edges: (p, conf, g, iou) of one page."""
    done, taken, out = set(), set(), set()
    for p, _, g, _ in sorted(edges, key=lambda e: (-(1.0 if e[1] is None else e[1]), e[0], -e[3], e[2])):
        if p not in done and g not in taken:
            done.add(p), taken.add(g), out.add((p, g))
    return out


def matched(spark, pages):
    rows = [(k, (p, c), (g, None), o) for k, edges in pages.items() for p, c, g, o in edges]
    got = P._matched(spark.createDataFrame(rows, f"page_id int, p {BOX}, g {BOX}, iou double"), PAGE).select("page_id", "p.idx", F.col("g.idx").alias("g")).collect()
    out = {k: set() for k in pages}
    for k, p, g in got:
        assert (p, g) not in out[k]
        out[k].add((p, g))
    return out


def test_matching_equals_the_greedy_loop(spark):
    rnd = random.Random(6)
    pages = {}
    for k in range(80):
        conf = {p: rnd.choice([None, 0.5, 0.5, 0.9, rnd.random()]) for p in range(12)}
        pairs = {(rnd.randrange(12), rnd.randrange(10)) for _ in range(rnd.randint(0, 40))}
        pages[k] = [(p, conf[p], g, rnd.choice([0.5, 0.6, 0.6, rnd.uniform(0.5, 1)])) for p, g in pairs]
    assert matched(spark, pages) == {k: greedy(e) for k, e in pages.items()}


def test_matching_of_a_long_chain_and_of_nothing(spark):
    # Each prediction would like the gold box that the one before it takes: 14 rounds.
    chain = [e for p in range(14) for e in ((p, 0.9 - p / 100, p, 0.6), (p, 0.9 - p / 100, p - 1, 0.9))][:-1]
    assert matched(spark, {1: chain, 2: []}) == {1: greedy(chain), 2: set()}
    plan = P._matched(spark.createDataFrame([], f"page_id int, p {BOX}, g {BOX}, iou double"), PAGE)
    assert plan.count() == 0 and "Python" not in plan._jdf.queryExecution().toString()


def agreement(spark, pages):
    rows = [(k, g, p) for k, ranks in pages.items() for g, p in ranks]
    return {r["page_id"]: (r["lines"], r["concordant"], r["pairs"], r["tau"]) for r in P.order_agreement(spark.createDataFrame(rows, "page_id int, g int, p double"), PAGE, "p", "g").collect()}


def test_order_agreement_equals_counting_pairs(spark):
    rnd = random.Random(7)
    pages = {k: [(rnd.randrange(30) if k % 2 else i, rnd.choice([float(i), rnd.random() * 20, 3.0])) for i in range(rnd.choice([1, 2, 3, 4, 5, 8, 9, 16, 17, 31]))] for k in range(60)}
    got = agreement(spark, pages)
    for k, ranks in pages.items():
        ranks = sorted(ranks)
        n = len(ranks)
        concordant = sum(ranks[i][1] < ranks[j][1] for j in range(n) for i in range(j))
        pairs = n * (n - 1) // 2
        assert got[k] == (n, concordant, pairs, round((2 * concordant - pairs) / pairs, 6) if pairs else None)


def test_order_agreement_of_a_page_of_20000_lines(spark):
    n = 20_000
    got = agreement(spark, {1: [(i, float(i ^ 1)) for i in range(n)], 2: [(i, float(-i)) for i in range(n)]})
    assert got[1][1] == n * (n - 1) // 2 - n // 2 and got[2][1] == 0 and got[2][3] == -1.0
