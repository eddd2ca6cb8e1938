"""Metric and page cases with literal expected values, and the additivity of the error parts."""

import random

import pytest
from pyspark.sql import functions as F

from folioworks.functions import distance as D
from folioworks.functions import scalars as S
from folioworks.operators import metrics as M
from folioworks.operators import page_eval as P
from folioworks.operators import reading_order as O

PRED = "page_id int, idx int, x1 double, y1 double, x2 double, y2 double, conf double, text string"
GOLD = "page_id int, idx int, x1 double, y1 double, x2 double, y2 double, text string"


def line(i, y, text, conf=None, x=0.0):
    return (1, i, x, float(y), x + 100.0, y + 20.0, *([conf] if conf is not None else []), text)


def test_gate(spark):
    rows = spark.createDataFrame([(1, "Ibu pada, hidup.", "ibu pada hidup", None), (2, "ibu pada hidup", "⟦زززز⟧ pada", 0.5), (3, "", "", None)], "id int, a string, b string, c double")
    got = {r["id"]: r["g"] for r in rows.select("id", D.agreement_gate(F.col("a"), F.col("b"), F.col("c")).alias("g")).collect()}
    assert got[1]["agreement"] == 1.0 and got[1]["passed"]
    assert got[2]["status"] == "flagged" and "dictionary covered 50.0%" in got[2]["reason"]
    assert got[3]["agreement"] == 0.0


def test_entities_and_ratings(spark):
    s = "struct<people:array<string>,places:array<string>>"
    items = spark.createDataFrame([({"people": ["Ali", "Abu"], "places": ["Kuala  Lumpur"]}, {"people": [" ali"], "places": ["kuala lumpur"]})], f"prediction {s}, gold {s}")
    got = {r["field"]: r for r in M.entity_scores(items, ["people", "places"]).collect()}
    assert (got["people"]["precision"], got["people"]["recall"], got["people"]["f1"]) == (0.5, 1.0, 0.666667)
    assert got[None]["precision"] == 0.666667
    good = spark.createDataFrame([("1", "a", "3", "4"), ("1", "b", "4", "5")], "item_id string, rater string, adequacy string, fluency string")
    assert M.rubric_summary(good).first()["adequacy_mean"] == 3.5
    with pytest.raises(Exception, match="out of 1 to 5"):
        M.rubric_summary(good.withColumn("adequacy", F.lit("7"))).collect()


def test_error_rates(spark):
    pairs = spark.createDataFrame([("a", "ڠا", "نا"), ("b", "ab", "ab")], "article_id string, ref string, hyp string")
    got = {r["article_id"]: r["cer"] for r in M.corpus_cer(pairs, "article_id").collect()}
    assert got == {"a": 0.5, "b": 0.0, None: 0.25}
    assert {r["letter"]: r["rate"] for r in M.letter_errors(pairs).collect()} == {"ڠ": 1.0}


def test_identical_texts(spark):
    same = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat")], "doc_id int, hyp string, ref string")
    assert M.corpus_chrf(same).first()["chrf"] == 100.0
    assert M.corpus_bleu(same).first()["bleu"] == 100.0
    r = M.rouge(same).first()
    assert (r["rouge1"], r["rouge2"], r["rouge_l"]) == (1.0, 1.0, 1.0)


def test_matched_line_cer(spark):
    gold = spark.createDataFrame([line(0, 0, "abcd"), line(1, 30, "efgh"), line(2, 60, "ijkl")], GOLD)
    pred = spark.createDataFrame([line(0, 0, "abXd", 0.9), line(1, 30, "efgh", 0.8), line(2, 200, "zz", 0.7)], PRED)
    r = P.page_scores(P.line_outcomes(pred, gold, ["page_id"]), ["page_id"]).filter("page_id = 1").first()
    assert (r["matched_edits"], r["missed_edits"], r["extra_edits"], r["edits"], r["gold_chars"]) == (1, 4, 2, 7, 12)
    assert (r["precision"], r["recall"]) == (0.666667, 0.666667)
    r = P.page_scores(P.line_outcomes(pred.limit(0), gold, ["page_id"]), ["page_id"]).filter("page_id = 1").first()
    assert (r["cer"], r["recall"], r["precision"]) == (1.0, 0.0, None)


def greedy(pred, gold):
    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        inter = w * h if w > 0 and h > 0 else 0.0
        return inter / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter)

    used, out = set(), set()
    for p in sorted(pred, key=lambda p: (-(1.0 if p[6] is None else p[6]), p[1])):
        best = max(((iou(p, g), -g[1]) for g in gold if g[1] not in used), default=(0, 0))
        if best[0] >= 0.5:
            used.add(-best[1])
            out.add((p[1], -best[1]))
    return out


def test_matching_equals_a_loop_and_parts_add_up(spark):
    rnd = random.Random(7)
    gold, pred = [], []
    for page in range(30):
        boxes = [(page, i, 10.0 * rnd.randint(0, 3), 8.0 * rnd.randint(0, 12)) for i in range(rnd.randint(0, 9))]
        gold += [(p, i, x, y, x + 60, y + 20, "g" * rnd.randint(1, 9)) for p, i, x, y in boxes]
        for j in range(rnd.randint(0, 9)):
            x, y = 10.0 * rnd.randint(0, 3) + 2, 8.0 * rnd.randint(0, 12) + 1
            pred.append((page, j, x, y, x + 60, y + 20, rnd.choice([None, 0.2, 0.5, 0.9]), "g" * rnd.randint(0, 9)))
    g, p = spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED)
    got = {}
    for r in P.match_lines(p, g, ["page_id"]).collect():
        got.setdefault(r["page_id"], set()).add((r["p"]["idx"], r["g"]["idx"]))
    for page in range(30):
        assert got.get(page, set()) == greedy([x for x in pred if x[0] == page], [x for x in gold if x[0] == page])
    outcomes = P.line_outcomes(p, g, ["page_id"])
    parts = {r["category"]: r["edits"] for r in P.error_breakdown(outcomes).collect()}
    total = P.page_scores(outcomes, ["page_id"]).filter("page_id is null").first()["edits"]
    assert total == sum(v for k, v in parts.items() if k.split("_")[0] in ("recognition", "extra", "missed"))


@pytest.mark.parametrize("order,tau", [([0, 1, 2, 3], 1.0), ([3, 2, 1, 0], -1.0), ([0, 2, 1, 3], 0.666667), ([0], None)])
def test_tau(spark, order, tau):
    rows = spark.createDataFrame([(1, i, o) for i, o in enumerate(order)], "page_id int, gr int, pr int")
    assert P.order_agreement(rows, ["page_id"], "pr", "gr").first()["tau"] == tau


def test_reading_order_of_two_columns(spark):
    rows = [(1, "h", 0, 100.0, 40.0, 1000.0, 75.0)]
    for k, y in enumerate((100, 150, 200, 250)):
        rows.append((1, f"l{k}", 10 + k, 100.0, float(y), 540.0, y + 30.0))
        rows.append((1, f"r{k}", 20 + k, 560.0, float(y), 1000.0, y + 30.0))
    rows.append((1, "n", 99, 520.0, 320.0, 560.0, 350.0))
    boxes = spark.createDataFrame(rows, "page_id int, name string, idx int, x1 double, y1 double, x2 double, y2 double").withColumn("page_width", F.lit(1100.0))
    got = [r["name"] for r in O.reading_order(boxes, ["page_id"]).orderBy("place").collect()]
    assert got == ["h", "r0", "r1", "r2", "r3", "l0", "l1", "l2", "l3", "n"]
    g = O.gutters(boxes.filter("name not in ('h', 'n')"), ["page_id"], 8.0).first()
    assert 541 <= g["lo"] + 1 and g["hi"] <= 560
    two = boxes.filter("name not in ('h', 'n')")
    assert [r["name"] for r in O.column_order(two, ["page_id"]).orderBy("place").collect()] == ["r0", "r1", "r2", "r3", "l0", "l1", "l2", "l3"]


def test_knowledge_answers(spark):
    full = '{"people":["Ali"," "],"places":"KL","dates":[],"organizations":[],"themes":[],"key_claims":[]}'
    rows = spark.createDataFrame([(1, f"```json\n{full}\n```"), (2, "{}"), (3, full.replace('"KL"', "5")), (4, "none")], "id int, r string")
    got = {r["id"]: r["k"] for r in rows.select("id", S.validate_knowledge(F.col("r")).alias("k")).collect()}
    assert got[1]["valid"] and got[1]["fields"]["people"] == ["Ali"] and got[1]["fields"]["places"] == ["KL"]
    assert got[2]["reason"].startswith("missing keys") and got[3]["reason"] == "not a list of strings: places" and got[4]["reason"] == "response is not a JSON object"
