"""Trust and distrust over chains, hubs, sinks and cycles against a plain power iteration, and their distance from the limit."""

import pytest

from folioworks.llm import url_filter as U

EDGES = [
    *((f"c{i}", f"c{i + 1}", 1) for i in range(40)),  # a chain; c40 is a sink
    *(("hub", f"leaf{i}", i % 3 + 1) for i in range(60)), *((f"leaf{i}", "hub", 1) for i in range(0, 60, 2)),
    ("x", "y", 1), ("y", "x", 5),  # a cycle: mass never leaves
    ("hub", "x", 7),
]
SEEDS = {1: {"c0": 1.0, "hub": 0.5, "x": 0.7, "alone": 0.3}, -1: {"c39": 0.4, "leaf4": 1.0, "y": 0.2}}


def walk(kind, rounds):
    out, shares = {}, {}
    for a, b, n in EDGES:
        a, b = (a, b) if kind == 1 else (b, a)
        out[a] = out.get(a, 0) + n
        shares[a, b] = n
    given = {h: s * (1 - U.DAMPING) for h, s in SEEDS[kind].items()}
    score = dict(given)
    for _ in range(rounds):
        new = dict(given)
        for (a, b), n in shares.items():
            if a in score:
                new[b] = new.get(b, 0) + score[a] * n / out[a] * U.DAMPING
        score = new
    return score


@pytest.mark.parametrize("residual", [0.2, U.RESIDUAL])
def test_scores_equal_a_power_iteration_and_are_near_their_limit(spark, residual):
    seeds = spark.createDataFrame([(k, h, s) for k, some in SEEDS.items() for h, s in some.items()], "kind int, host string, seed double")
    got = {(r["kind"], r["host"]): r["score"] for r in U.propagate(seeds, spark.createDataFrame(EDGES, "src string, dst string, n long"), residual=residual).collect()}
    for kind in (1, -1):
        mine = {h: s for (k, h), s in got.items() if k == kind}
        assert mine == pytest.approx(walk(kind, U.rounds_for(residual)), abs=1e-12)
        limit = walk(kind, 400)
        short = sum(s - mine.get(h, 0.0) for h, s in limit.items())
        assert -1e-9 <= short <= residual * sum(SEEDS[kind].values())
        assert all(mine.get(h, 0.0) <= s + 1e-9 for h, s in limit.items())


def test_rounds():
    assert U.rounds_for(0.01) == 29 and U.rounds_for(0.9) == 1
    assert U.DAMPING ** U.rounds_for(0.01) <= 0.01
