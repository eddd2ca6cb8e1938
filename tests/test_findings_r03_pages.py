"""Cases of the findings of round 3 on whole pages."""

import random

from pyspark.sql import functions as F

from folioworks.operators import reading_order as O
from folioworks.plans import dataset_plans, inputs

BOX = "page_id int, idx int, x1 double, x2 double, y1 double, y2 double"


def _column_places(rows):
    """Columns by union of tied boxes, one page after the other."""
    out = {}
    for page in {r[0] for r in rows}:
        own, label = [r for r in rows if r[0] == page], {r[1]: r[1] for r in rows if r[0] == page}
        for _ in own:
            for p in own:
                for q in own:
                    inter = min(p[3], q[3]) - max(p[2], q[2])
                    if inter > 0 and inter / max(1e-6, min(p[3] - p[2], q[3] - q[2])) >= 0.5:
                        label[p[1]] = label[q[1]] = min(label[p[1]], label[q[1]])
        columns = {n: [(r[2] + r[3]) / 2 for r in own if label[r[1]] == n] for n in label.values()}
        order = sorted(own, key=lambda r: (-sum(columns[label[r[1]]]) / len(columns[label[r[1]]]), label[r[1]], (r[4] + r[5]) / 2, r[1]))
        out |= {(page, r[1]): k for k, r in enumerate(order)}
    return out


def _places(df):
    return {(r["page_id"], r["idx"]): r["place"] for r in O.column_order(df, ["page_id"]).collect()}


def test_columns_that_are_whole_at_sight_go_through_no_rounds(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(O, "_meeting", lambda boxes, *a, f=O._meeting: (asked.append({r["page_id"] for r in boxes.select("page_id").distinct().collect()}), f(boxes, *a))[1])
    plain = [(page, k, 100.0 + 460 * (k % 2), 440.0 + 460 * (k % 2) + k, 30.0 * k, 30.0 * k + 20) for page in (1, 2) for k in range(9)]
    assert _places(spark.createDataFrame(plain, BOX)) == _column_places(plain)
    assert asked == []
    # page 3: the middle box is tied to neither; page 4: tied to the first, which is neither the last nor the furthest before it
    odd = [(3, 0, 0.0, 100.0, 0.0, 9.0), (3, 1, 90.0, 200.0, 20.0, 29.0), (3, 2, 190.0, 300.0, 10.0, 19.0), (4, 7, 0.0, 64.0, 0.0, 9.0), (4, 1, 1.0, 200.0, 5.0, 9.0), (4, 2, 2.0, 60.0, 9.0, 9.5), (4, 3, 59.0, 61.0, 1.0, 2.0)]
    assert _places(spark.createDataFrame(plain + odd, BOX)) == _column_places(plain + odd)
    assert len(asked) == 1 and asked[0] <= {3, 4}


def test_columns_of_any_boxes_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for page in range(120):
        for k in range(rng.randint(1, 9)):
            x = float(rng.randint(0, 30))
            rows.append((page, k, x, x + rng.choice([-2, 0, 1, 3, 5, 8, 13, 21]), float(rng.randint(0, 5)), 6.0))
    assert _places(spark.createDataFrame(rows, BOX)) == _column_places(rows)


def test_a_page_is_shuffled_once(spark, tmp_path):
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(1, 5, 1, "A", "F"), (1, 3, 1, "A", "F"), (2, 9, 1, None, "O")], schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = inputs.gold_lines(spark, str(tmp_path), by_page=True)
    assert sorted(rows.collect()) == sorted(inputs.gold_lines(spark, str(tmp_path)).collect())
    plan = rows.groupBy("page_id").agg(F.collect_list("text"))._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1


def test_tasks_are_counted_where_they_are(spark, tmp_path):
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    rows = [(1, 8, 7, "A", "F"), (1, 5, 1, "A", "F"), (1, None, 2, "N", "O"), (2, None, 5, None, "O"), (3, None, 1, "R", "F")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = dataset_plans.import_tasks(spark, str(tmp_path))
    got = {r["page_id"]: tuple(r)[1:] for r in out.collect()}
    # left edges are 100 or 560 of 1200, an unknown part has no width unless the line is a fifth of six
    assert got == {1: (3, 3, 3, 126.667, 115.5, "line 5 F A\nline O N\nline 8 F A"), 2: (1, 1, 1, 16.667, 0.0, "line O"), 3: (1, 1, 1, 16.667, None, "line F R")}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange") == 1 and "Generate" not in plan
