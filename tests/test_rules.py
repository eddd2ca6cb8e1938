"""Literal cases of texts, statuses and scores, and orders against plain versions."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioworks.functions import distance as D
from folioworks.functions import scalars as S
from folioworks.functions import text as X
from folioworks.operators import lexicon as L
from folioworks.operators import metrics as M
from folioworks.operators import page_eval as E
from folioworks.operators import reading_order as O
from folioworks.operators import runs as R


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(make(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_blank_provider_type_and_route(spark):
    assert column(spark, [None, "", "\n\t ", " ", "x"], S.is_empty) == [True, True, True, True, False]
    assert column(spark, [None, [], ["a"]], S.is_empty_list, "array<string>") == [True, True, False]
    none = F.create_map().cast("map<string,string>")
    names = ["x_Qwen.txt", "kraken_1.txt", "tesseract.txt", "OCR_output.txt", "plain.txt"]
    assert column(spark, names, lambda v: X.infer_provider(none, v, F.lit(""))) == ["qwen-fixture", "kraken-fixture", "tesseract", "tesseract", "text-fixture"]
    texts = ["Jawi LLM-OCR Result (Qwen)", "jawi llm-ocr result (kraken)", "Jawi OCR Result", "else"]
    assert column(spark, texts, lambda v: X.infer_provider(none, F.lit("a.txt"), v)) == ["qwen-fixture", "kraken-fixture", "tesseract", "text-fixture"]
    assert column(spark, ["satu dua", " ".join(["w"] * 10)], lambda v: S.route(v)["label"]) == ["Short snippet (2 words) — skipping summary agent", "Full article (10 words) — running all 4 agents"]
    status = lambda v: S.input_status(v, F.lit(1), F.lit(1), F.lit("pdf"), 5, 9, 9)
    assert column(spark, [" \n", "abc", "abcdef", " " * 6], status) == [400, None, 413, 413]


def test_small_functions(spark):
    at = [datetime(2024, 1, 2, 3, 4, 5, 600_000)]
    assert column(spark, at, S.iso_seconds, "timestamp") == ["2024-01-02T03:04:05Z"]
    assert column(spark, at, lambda v: S.elapsed(v, v + F.expr("interval 90 seconds")), "timestamp") == [90.0]
    assert column(spark, [None, 0.2, 0.9], lambda v: S.low_confidence(v, 0.6), "double") == [None, True, False]
    assert column(spark, ["a\nb\nc", None], lambda v: S.preview(v, 2)) == ["a\nb", ""]
    assert column(spark, [" é  x\n", None], X.normalise_output) == ["é x", ""]
    assert column(spark, ["My file (1).pdf", "..", None], X.safe_name) == ["My_file_1_.pdf", "document", "document"]
    assert column(spark, [[" b", "a", "b ", ""]], X.distinct_in_order, "array<string>") == [["b", "a"]]


def pairs(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, ref string, hyp string")


def test_scores_of_short_and_missing_texts(spark):
    assert M.corpus_bleu(pairs(spark, [("a b", "a b")])).first()["bleu"] == 0.0
    assert M.corpus_bleu(pairs(spark, [("a b", None), (None, None)])).first()["bleu"] == 0.0
    assert M.corpus_bleu(pairs(spark, [("a b c d e", "a b c d e")])).first()["bleu"] == 100.0
    assert M.corpus_chrf(pairs(spark, [("", ""), ("ab", None)])).first()["chrf"] == 0.0
    assert M.corpus_chrf(pairs(spark, [("abcdefg", "abcdefg")])).first()["chrf"] == 100.0
    r = M.corpus_cer(pairs(spark, [("abcd", None), (None, "x")])).first()
    assert (r["edits"], r["chars"], r["cer"]) == (5, 4, 1.25)
    g = pairs(spark, [("ibu pada hidup", "ibu pada hidup")]).select(D.agreement_gate(F.col("ref"), F.col("hyp")).alias("g"))
    assert g.first()["g"]["agreement"] == 1.0
    plan = pairs(spark, [("a", "b")]).select(D.agreement_gate(F.col("ref"), F.col("hyp"), composed=True).alias("g")).select("g.agreement", "g.passed", "g.status", "g.reason")
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("levenshtein") == 1


def test_a_matched_line_without_text_is_all_wrong(spark):
    line = "page_id int, idx int, x1 double, y1 double, x2 double, y2 double, text string, conf double"
    gold, pred = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, "abcd", None)], line), spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, None, 0.9)], line)
    s = E.page_scores(E.line_outcomes(pred, gold, ["page_id"]), ["page_id"]).filter("page_id = 1").first()
    assert (s["matched_edits"], s["cer"]) == (4, 1.0)


def test_run_status(spark):
    rows = [("a", "ocr", "completed"), ("b", "ocr", "failed_timeout"), ("c", "agreement_gate", "skipped"), ("d", "error", "x"), ("d", "ocr", "completed"), ("e", "ocr", "running"), ("f", "agreement_gate", "flagged"), ("g", "summary", "skipped")]
    stages = spark.createDataFrame([(*r, 1.0) for r in rows], "run_id string, stage string, status string, duration double")
    got = {r["run_id"]: r["status"] for r in R.run_status(stages).collect()}
    assert got == {"a": "completed", "b": "needs_review", "c": "needs_review", "d": "failed", "e": "needs_review", "f": "needs_review", "g": "completed"}


def test_pair_counts_and_whole_phrases(spark):
    words = spark.createDataFrame([(["pada", "ڤد"], 0), (["x1", "س"], 1), (["lone"], 2)], "pair array<string>, ord long")
    phrases = spark.createDataFrame([("ibu pada", "ايبو ڤد", 0), ("satu dua", "ساتو", 1)], "rumi string, jawi string, ord long")
    got = {r["source"]: tuple(r)[1:] for r in L.pair_counts(L.judged_pairs(words, phrases)).collect()}
    assert got == {"word": (3, 2, 1), "phrase": (3, 2, 2)}


def boxes(spark, seed, pages=25, least=1, most=25):
    rnd, rows = random.Random(seed), []
    for page in range(pages):
        for idx in range(rnd.randint(least, most)):
            x, y = rnd.choice([100, 400, 700]) + rnd.randint(0, 60), rnd.randint(0, 900)
            rows.append((page, idx, float(x), float(y), float(x + rnd.randint(20, 320)), float(y + rnd.randint(10, 60)), rnd.choice([0.2, 0.5, rnd.random()]), 1100.0))
    return rows, spark.createDataFrame(rows, "page_id int, idx int, x1 double, y1 double, x2 double, y2 double, conf double, page_width double")


def by_page(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_suppressed_boxes_equal_a_plain_version(spark):
    rows, df = boxes(spark, 1)
    got = by_page([tuple(r) for r in O.suppress_contained(df, ["page_id"]).select("page_id", "idx").collect()])
    for page, bs in by_page(rows).items():
        kept = []
        for b in sorted(bs, key=lambda b: (-b[6], b[1])):
            def inside(k):
                w, h = min(b[4], k[4]) - max(b[2], k[2]), min(b[5], k[5]) - max(b[3], k[3])
                return w > 0 and h > 0 and w * h / min((x[4] - x[2]) * (x[5] - x[3]) for x in (b, k)) > 0.6
            if not any(inside(k) for k in kept):
                kept.append(b)
        assert sorted(i for _, i in got[page]) == sorted(k[1] for k in kept)


def test_columns_equal_a_plain_version(spark):
    rows, df = boxes(spark, 2)
    got = {(r["page_id"], r["idx"]): r["place"] for r in O.column_order(df, ["page_id"]).collect()}
    for page, bs in by_page(rows).items():
        group = {b[1]: {b[1]} for b in bs}
        for a in bs:
            for b in bs:
                inter = min(a[4], b[4]) - max(a[2], b[2])
                if inter > 0 and inter / min(a[4] - a[2], b[4] - b[2]) >= 0.5 and group[a[1]] is not group[b[1]]:
                    both = group[a[1]] | group[b[1]]
                    for i in both:
                        group[i] = both
        centre = {min(g): sum((b[2] + b[4]) / 2 for b in bs if b[1] in g) / len(g) for g in group.values()}
        want = sorted(bs, key=lambda b: (-centre[min(group[b[1]])], min(group[b[1]]), (b[3] + b[5]) / 2, b[1]))
        assert [b[1] for b in want] == sorted(group, key=lambda i: got[page, i])


def test_gutters_equal_a_plain_scan(spark):
    rows, df = boxes(spark, 3, pages=60)
    got = {r["page_id"]: (r["lo"], r["hi"], r["cover"]) for r in O.gutters(df, ["page_id"], 8.0).collect()}
    for page, bs in by_page(rows).items():
        found, start = [], None
        lo, hi = min(int(b[2]) for b in bs), max(int(b[4]) for b in bs)
        cover = {x: sum(int(b[2]) <= x <= int(b[4]) for b in bs) for x in range(lo, hi + 2)}
        for x in range(lo, hi + 2):
            thin = x <= hi and cover[x] <= (1 if len(bs) < 40 else 2)
            if thin and start is None:
                start = x
            if not thin and start is not None:
                least = min(cover[k] for k in range(start, x))
                left = sum((b[2] + b[4]) / 2 < (start + x) / 2 for b in bs)
                if x - start >= (1 if least == 0 else 8) and 2 <= left <= len(bs) - 2:
                    found.append((least, start - x, start, x))
                start = None
        want = min(found)[2:] + (min(found)[0],) if found and len(bs) >= 4 else None
        assert got.get(page) == want


#: Two columns of four lines, and what stands around them: (name, x1, y1, x2, y2), in reading order.
RIGHT, LEFT = [(f"r{i}", 560, y, 1000, y + 30) for i, y in enumerate((100, 150, 200, 250))], [(f"l{i}", 100, y, 540, y + 30) for i, y in enumerate((100, 150, 200, 250))]


@pytest.mark.parametrize("layout", [
    RIGHT + LEFT,
    [("head", 100, 20, 1000, 90), *RIGHT, *LEFT],
    [*RIGHT, *LEFT, ("number", 540, 320, 570, 345)],
    [*RIGHT, *LEFT, ("below", 100, 400, 1000, 430)],
    [("only", 0, 0, 10, 10)],
    [("b", 50, 0, 90, 10), ("a", 0, 0, 40, 10)],
])
def test_reading_orders(spark, layout):
    shuffled = sorted(layout, key=lambda b: hash(b[1:]) % 97)
    df = spark.createDataFrame([(1, i, *map(float, b[1:]), 1100.0, b[0]) for i, b in enumerate(shuffled)], "page_id int, idx int, x1 double, y1 double, x2 double, y2 double, page_width double, name string")
    assert [r["name"] for r in O.reading_order(df, ["page_id"]).orderBy("place").collect()] == [b[0] for b in layout]
