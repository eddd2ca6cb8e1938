"""Cross-parsing against plain search for the longest match, and predictions against a plain version of the whole query."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from folioworks.llm import language_id as li


def plain_normalised(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return "".join(f" {w}" for w in words).encode()


def plain_phrases(data, sample):
    n = at = 0
    while at < len(data):
        k = 0
        while at + k < len(data) and data[at : at + k + 1] in sample:
            k += 1
        at += max(1, k)
        n += 1
    return n


def words(rnd, letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 5))) for _ in range(n))


def test_normalised_texts():
    texts = ["Ünï-Code 12 x", None, "", "  A\n\tb ", "½ 3", "日本 語", "İ"]
    data, ends = li.normalised(texts)
    assert [data[a:b] for a, b in zip([0, *ends], ends)] == [plain_normalised(t) for t in texts]


def test_phrases_equal_the_longest_matches():
    rnd = random.Random(3)
    sample = {"x": words(rnd, "abéc", 60), "y": "aaa aaaa bbb " + words(rnd, "abéc", 30)}
    parser = li.Parser(li.Model(sample))
    texts = [words(rnd, "abéc", rnd.randint(0, 700)) for _ in range(20)]
    texts += ["a" * 3000, "ab" * 2000, None, "", "12 3", "zzzz", "a" * 513, sample["x"] * 9, sample["y"], words(rnd, "abéc", 3000), "caaa" * 1500, "x a", "日本 a"]
    data, ends = li.normalised(texts)
    got, starts = parser.phrases(data, ends), np.r_[0, ends[:-1]]
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        for k, lang in enumerate(parser.languages):
            assert got[k, i] == plain_phrases(data[a:b], plain_normalised(sample[lang])), (i, lang)


def test_automaton_holds_all_substrings():
    text = b"abracadabra abba"
    moves = li.suffix_automaton(text)

    def known(s):
        state = 0
        for c in s:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    assert all(known(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1))
    assert not any(known(s) for s in (b"aa", b"bd", b"abrab", b"cc"))


def test_predictions_equal_a_plain_version(spark):
    rnd = random.Random(4)
    rows = [(i, words(rnd, letters, rnd.randint(1, 200)), lang) for i, (lang, letters) in enumerate([("x", "abcde"), ("y", "cdefg"), ("z", "xyzab")] * 20)]
    rows += [(100, None, "x"), (101, "", "y"), (102, "12 !", None), (103, words(rnd, "abcde", 20), None), (None, words(rnd, "cdefg", 9), "y"), (104, rows[0][1], "x"), (104, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "h": F.lit(1), "piece": F.lit(1), "said": F.lit(2)})
    got = sorted(((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in li.predict_languages(docs).collect()), key=str)

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    sample = li.training_sample(docs.filter(~li.held_out("doc_id")), "text", "lang")
    pieces = {lang: {t[k : k + li.PIECE] for i, t, own in rows if own == lang and t and not held(i) for k in range(0, len(t), li.PIECE)} for lang in "xyz"}
    for lang, text in sample.items():  # the sample is made of whole pieces, as many as the bound allows
        used = [p for p in pieces[lang] if p in text]
        assert len(used) == min(li.SAMPLE_PIECES, len(pieces[lang])) and len(text) == sum(map(len, used)) + len(used) - 1
    want = []
    for i, text, _ in rows:
        data = plain_normalised(text)
        if not data:
            want.append((i, held(i), "und", 0.0))
            continue
        costs = sorted((plain_phrases(data, s) * math.log2(2 + len(s)) / len(data), lang) for lang, s in ((k, plain_normalised(v)) for k, v in sample.items()))
        want.append((i, held(i), costs[0][1], round(max(0.0, 1 - costs[0][0] / costs[1][0]), 9)))
    assert got == sorted(want, key=str)


def test_rows_of_any_length_are_learned_from(spark):
    rnd = random.Random(5)
    rows = [(i, words(rnd, "abc", 20_000), "long") for i in range(1, 9)] + [(i, words(rnd, "xyz", 50), "short") for i in range(10, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in li.predict_languages(docs).filter("doc_id < 10").collect()} == {"long"}


def test_ties_empty_tables_and_no_labels(spark):
    docs = spark.createDataFrame([(i, "ab ba", lang) for i, lang in ((1, "q"), (2, "q"), (3, "p"), (4, "p"), (7, "q"), (8, "p"))], "doc_id long, text string, lang string")
    out = li.predict_languages(docs).collect()
    assert {(r["lang_pred"], r["score"]) for r in out} == {("p", 0.0)}
    assert li.predict_languages(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in li.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
