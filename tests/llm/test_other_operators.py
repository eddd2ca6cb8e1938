"""LM scores, media, URL verdicts, languages, chats, archives and toxicity on small fixtures."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.llm import chat_format, language_id, lm_score, media_chunks, toxicity, url_filter, warc

ODD = [(90, None), (91, ""), (92, " \t\n"), (93, "word " * 30_000), (94, "Ünïcödé ünïcödé"), (94, "Ünïcödé ünïcödé")]


def docs(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).withColumn("target", F.lit("x")) if extra else df


# --- LM scores


def test_lm_scores_equal_plain_counting(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "Delta", f"w{rnd.randint(0, 3000)}"]) for _ in range(rnd.randint(0, 40)))) for i in range(60)] + ODD
    target = {i for i in range(0, 60, 3)}
    got = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(docs(spark, rows), spark.createDataFrame([(i,) for i in target], "doc_id long")).collect()}

    words = Counter(w for _, t in rows for w in (t or "").lower().split())
    assert len(words) < lm_score.SIZE
    code = {w: i + 1 for i, w in enumerate(words)}.__getitem__
    pairs = {}
    for name, chosen in (("target", [t for i, t in rows if i in target]), ("background", [t for _, t in rows])):
        bi, uni, ctx = Counter(), Counter(), Counter()
        for t in chosen:
            ids = [0, *map(code, (t or "").lower().split())]
            bi.update(zip(ids, ids[1:]))
        for (a, b), n in bi.items():
            uni[b] += n
            ctx[a] += n
        total = sum(uni.values()) + 0.5 * (lm_score.SIZE - 1)
        pairs[name] = lambda a, b, bi=bi, uni=uni, ctx=ctx, total=total: -math.log2((bi[a, b] + lm_score.KAPPA * (uni[b] + 0.5) / total) / (ctx[a] + lm_score.KAPPA))
    for i, t in rows:
        ids = [0, *map(code, (t or "").lower().split())]
        r = got[i]
        assert r["n_tokens"] == len(ids) - 1
        if len(ids) == 1:
            assert r["score"] is None and r["loss_target"] is None
            continue
        for name in pairs:
            assert r[f"loss_{name}"] == pytest.approx(sum(pairs[name](a, b) for a, b in zip(ids, ids[1:])) / (len(ids) - 1), abs=1e-4)
        assert r["score"] == pytest.approx(r["loss_target"] - r["loss_background"], abs=1e-6)


def test_lm_scores_without_rows_or_target(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert lm_score.cross_entropy_difference(docs(spark, []), none).count() == 0
    assert lm_score.cross_entropy_difference(docs(spark, [(1, "a b")]), none).first()["n_tokens"] == 2


# --- media


def test_media_round_trip(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefgh \n") for _ in range(60_000))
    rows = [*ODD, (1, "x" * 576), (2, "x" * 577), (3, long), (4, long[:30_000] + "!" + long[30_000:]), (5, long), (6, "once only")]
    out = media_chunks.media_columns(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    text = dict(rows)
    for r in out:
        raw = (text[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(media_chunks.wav(payload)).hexdigest() and r["media_bytes"] == len(payload) + 44
    assert media_chunks.media_columns(docs(spark, [])).count() == 0


def test_chunks_survive_an_insertion():
    data = np.random.default_rng(3).integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    a, b = media_chunks.chunks_of(data), media_chunks.chunks_of(data[:1000] + b"inserted" + data[1000:])
    assert b"".join(a) == data and all(len(c) <= media_chunks.MOST for c in a) and all(len(c) >= media_chunks.LEAST for c in a[:-1])
    assert len(set(a) & set(b)) >= len(a) - 2
    assert b"".join(media_chunks.chunks_of(b"\0" * 300_000)) == b"\0" * 300_000


# --- URLs


PAGES = [
    (1, "https://A.Example.com/en/x?q#f", None), (2, "http://www.example.com/en/", ""), (3, "http://b.net/es/1", '<a href="http://spam.org/x">s</a>'), (4, "http://b.net/other", "<a HREF='http://c.org/'>c</a>"), (5, None, None), (6, "no host", None),
    (7, "http://c.org", '<a class="x" href="http://b.net/">b</a>'), (8, "ftp://com/", None), (9, "http://d.org?x://y/z", None), (3, "http://b.net/es/1", None), (10, "http://notcom/", None), (11, "http://b.net/es/2", None), (12, "http://b.net/fr/2", None),
]


def test_url_verdicts(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(1))
    rules = spark.createDataFrame(url_filter.RULES, "action string, rule_host string, rule_path string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()), key=str)
    want = [
        (1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "www.example.com", "/en/", "www.example.com/en/", "allow"), (3, "b.net", "/es/1", "net/es/", "block"), (3, "b.net", "/es/1", "net/es/", "block"), (4, "b.net", "/other", None, "block"), (5, "", "", None, "allow"),
        (6, "", "", None, "allow"), (7, "c.org", "", None, "block"), (8, "com", "/", "com/", "allow"), (9, "d.org", "", None, "allow"), (10, "notcom", "/", None, "allow"), (11, "b.net", "/es/2", "net/es/", "block"), (12, "b.net", "/fr/2", "net/fr/", "block"),
    ]
    assert got == sorted(want, key=str)
    assert url_filter.judge(pages.limit(0), rules).count() == 0


# --- languages


def test_languages(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_001, None, "en"), (10_002, "", "de"), (10_003, "123 !?", None), (None, "the and of this", None)], "doc_id long, text string, lang string")
    out = language_id.predict_languages(d.unionByName(odd).withColumn("score", F.lit("x"))).collect()
    got = {r["doc_id"]: r for r in out}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0.0 for k in (10_001, 10_002, 10_003))
    assert got[None]["lang_pred"] == "en" and not got[None]["held_out"]
    labels = {r["doc_id"]: r["lang"] for r in d.collect()}
    held = [r for r in out if r["held_out"] and r["lang_pred"] != "und"]
    assert len(held) > 20 and sum(labels[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert language_id.predict_languages(d.limit(0)).count() == 0


# --- chats


def test_preference_examples(spark):
    turns = "pair_id long, turn long, role string, text string"
    c = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (2, 0, "user", None), (3, 0, "user", "x"), (3, 1, "assistant", "same"), (5, 0, "user", "q")], turns)
    r = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "bb"), (1, 2, "user", "?"), (3, 0, "user", "x"), (3, 1, "assistant", "same"), (4, 0, "user", "only")], turns)
    got = {x["pair_id"]: x for x in chat_format.preference_examples(c.withColumn("prompt", F.lit(1)), r).collect()}
    one = got[1]
    assert one["prompt"] == "<|user|>\nhi<|end|>\n" and one["shared_turns"] == 1
    whole = one["prompt"] + one["chosen"]
    assert [whole[s["start"] : s["end"]] for s in one["chosen_mask"]] == ["a<|end|>\n"]
    whole = one["prompt"] + one["rejected"]
    assert [whole[s["start"] : s["end"]] for s in one["rejected_mask"]] == ["bb<|end|>\n"]
    assert (got[3]["chosen"], got[3]["rejected"], got[3]["shared_turns"]) == ("", "", 2)
    many = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)] + [(None, 0, "assistant", "x"), (None, None, None, None)], turns)
    rows = {x["pair_id"]: x for x in chat_format.preference_examples(many, many.filter("turn < 1000 or pair_id is null")).collect()}
    assert len(rows) == 2 and rows[1]["shared_turns"] == 1000 and len(rows[1]["chosen_mask"]) == 1000 and rows[None]["shared_turns"] == 2
    whole = rows[1]["prompt"] + rows[1]["chosen"]
    assert [whole[m["start"] : m["end"]] for m in rows[1]["chosen_mask"]][:2] == ["t1001<|end|>\n", "t1003<|end|>\n"]
    assert (got[4]["chosen"], got[4]["prompt"]) == ("", "") and got[2]["chosen"] == "<|user|>\n<|end|>\n"
    assert chat_format.preference_examples(c.limit(0), r.limit(0)).count() == 0


# --- archives


def test_archives_read_back(spark):
    rows = [(1, "http://a/x", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "http://d/ü?q=1", "p\r\n\r\nWARC/1.1\r\n\r\nü\r\n" * 3), (6, "http://e", "z" * 300_000), (6, "http://e", "z" * 300_000)]
    rows += [(1, "http://b/y", "same"), (1, "http://a/x", "same"), (None, None, None), (None, None, None), (None, "http://n", "only nulls"), (None, "http://n", "only nulls"), (7, "http://f", "\r\n"), (8, "http://g", "\r\n\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(1)).withColumn("row", F.lit(1)).withColumn("salt", F.lit(1))
    got = []
    for r in warc.captures(pages, with_payload=True).collect():
        stored = r["response"] if r["response"]["type"] == "response" else r["original"]
        if r["response"]["type"] == "response":
            raw = bytes(r["response"]["payload"])
            assert r["original"] is None and base64.b32encode(hashlib.sha1(raw).digest()).decode() == stored["digest"] and len(raw) == stored["payload_bytes"]
        assert len(r["requests"]) == 1 and len(r["metadata"]) == 1
        got.append((r["page_id"], r["response"]["target"], stored["payload_bytes"], stored["digest"], r["response"]["type"], r["original"] and r["original"]["page_id"]))
    want = []
    for i, url, html in rows:
        raw = (html or "").encode()
        last = max((j for j, _, h in rows if (h or "") == (html or "")), key=lambda j: -1 if j is None else j)
        target = (url or "").replace("\r\n", " ")
        want.append((i, target, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == last else "revisit", None if i == last else last))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.captures(pages.limit(0)).count() == 0


# --- toxicity


def test_ordinal_fit_orders_grades():
    x = np.random.default_rng(5).poisson(1.0, (400, 6)).astype(float)
    grade = np.digitize(x[:, 0] + x[:, 1], [1, 3, 5])
    w, t = toxicity.fit_ordinal(x, grade, 3, l2=1e-4)
    assert w[0] > 3 * abs(w[2]) and w[1] > 3 * abs(w[3]) and list(t) == sorted(t)
    expected = (1 / (1 + np.exp(t[None, :] - (x @ w)[:, None]))).sum(axis=1)
    assert np.corrcoef(expected, grade)[0, 1] > 0.85


def test_toxicity(spark):
    rnd = random.Random(6)
    clean, bad = [f"good{i}" for i in range(50)], ["idiot", "scum", "moron"]
    rows, labels = [], []
    for i in range(1000, 1300):
        words = [rnd.choice(clean) for _ in range(rnd.randint(5, 40))]
        toxic = i % 6 == 0
        if toxic:
            words += [rnd.choice(bad) for _ in range(rnd.randint(2, 9))]
        rows.append((i, " ".join(words)))
        labels += [(i, int(toxic))] if i % 2 == 0 else []
    d = docs(spark, [*rows, *ODD, rows[0], (1002, "good1 idiot good2 scum")])
    model = toxicity.fit(d, spark.createDataFrame([*labels, (None, 1), (5000, 1), (1004, None), (94, 0)], "doc_id long, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.score(d, model).collect() if r["doc_id"] != 1002}
    assert all(out[i]["toxic"] == (i % 6 == 0) for i in range(1000, 1300) if i != 1002)
    assert out[90]["severity"] == 0.0 and not out[91]["toxic"]
    assert toxicity.score(d.limit(0), model).count() == 0
    nothing = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(r["toxic"] for r in toxicity.score(d, nothing).collect())
