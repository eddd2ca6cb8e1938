import random
import re

from folioworks.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = []
    for key, text in items:
        w = words(text)
        n = min(10, len(w))
        if n:
            windows += [(key, tuple(w[i : i + n])) for i in range(len(w) - n + 1)]
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
        out.append((key, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = ["the", "of", "and", "Ünd", "été", "x1", "7", "a"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 9, 10, 11, 14, 40])))) for i in range(12)]
    items += [(90, None), (91, "?!"), (92, items[3][1]), (0, "the a the a the a")]
    docs = []
    for i in range(60):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.6:
            source = words(rnd.choice(items)[1])
            a = rnd.randint(0, max(0, len(source) - 8))
            at = rnd.randint(0, len(w))
            w[at:at] = source[a : a + rnd.choice([8, 9, 10, 11, 30])]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(w)))
    docs += [(100, None), (101, ""), (102, docs[0][1]), (0, docs[1][1]), (None, items[0][1])]
    out = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", dc.F.lit("x")), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in out.collect()), key=str)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in dc.contamination(docs, none).collect()] == [(1, 3, 0)]
    assert dc.contamination(docs.limit(0), none).count() == 0


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "q a b c d e f g h i j z")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g h i j")], "item_id long, text string")
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    assert [(r["n_hit"], r["items"]) for r in dc.contamination(docs, items).collect()] == [(10, ["7"])]


def test_repeated_words_stay_linear(spark):
    n = 20_000
    docs = [(1, "same " * n), (2, "x y " * n), (3, "a b c d e f g h i j k " + "same " * 9), (3, "same " * 12)]
    items = [(7, "same " * n), (8, "y x " * 300 + "same " * 50), (9, "same " * 10), (10, "same " * 9)]
    out = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out)
    assert got == [(1, n, n, ["10", "7", "8", "9"]), (2, 2 * n, 2 * n, ["8"]), (3, 12, 12, ["10", "7", "8", "9"]), (3, 20, 9, ["10"])]
    spans = {(r["doc_id"], r["n_words"]): [tuple(s) for s in r["hit_spans"]] for r in out}
    assert spans[1, n] == [(0, n)] and spans[3, 20] == [(11, 20)]
