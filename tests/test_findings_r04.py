"""Cases of the findings of round 4."""

import glob
import random
import shutil
from collections import Counter

import duckdb
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioworks.functions.text import LATIN
from folioworks.llm import common as C
from folioworks.llm import filter_audit as A
from folioworks.llm import shingle_join as J
from folioworks.operators import lexicon as L
from folioworks.plans import registry
from folioworks.streaming import runs as T


def test_coverage_equals_its_sql_on_odd_documents(spark, sf_dir, tmp_path):
    rows = [
        (1, "the phone of İstanbul"), (2, None), (3, ""), (4, "12 34 é"), (5, "twice of one"), (5, "twice of two qqqq"), (None, "no id"), (None, "none either"),
        # 2,739 / 5,120 has a five as its tenth and last place
        (6, " ".join(["of"] * 2739 + ["zzqqj"] * 2381)), (7, "-".join(["a"] * 5000)),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{sf_dir}/benchmark.parquet", tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet'")
    for name in ("lexicon_document_coverage", "lexicon_word_lookup", "lexicon_coverage_report"):
        got = registry.queries()[name](spark, str(tmp_path)).collect()
        assert Counter(map(tuple, got)) == Counter(con.execute(registry.oracle_sql()[name]).fetchall()), name


def _events(spark, path, rows):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    frame = spark.createDataFrame(rows, "event_id long, day int, user_id long, event_type string, value double")
    frame.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, day, 0, user_id % 60) AS ts", "user_id", "event_type", "value").to(StructType.fromDDL(schema)).repartition(2).write.parquet(f"{path}/events.parquet")


def test_runs_share_rows_of_state_and_equal_their_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BUCKETS", 4)
    # a folder of two files; the second half of the numbers begins at the first day again
    rows = [(n, n % 10, n // 20, ("view", "click", "purchase")[n % 7 % 3], float(n % 100)) for n in range(400)]
    _events(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("stream_live_state", "stream_complete_articles", "stream_replayed"):
        found = registry.queries()[name](spark, str(tmp_path))
        want = con.execute(registry.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert Counter(map(tuple, found.select(*names).collect())) == Counter(want.fetchall()), name


def test_many_runs_are_few_rows_of_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "BUCKETS", 4)
    (tmp_path / "log").mkdir()
    spark.range(200).selectExpr("concat('r', id) AS run_id", "CAST(9007199254740993 + id AS long) AS seq", "timestamp'2024-01-01 00:00:00' AS ts", "IF(id = 7, 'pipeline_done', 'ocr') AS stage", "'x' AS status").unionByName(
        spark.sql("SELECT 'r0' AS run_id, CAST(NULL AS long) AS seq, timestamp'2024-01-01 00:00:00' AS ts, 'gate' AS stage, 'y' AS status")
    ).write.json(f"{tmp_path}/log/1")
    log = spark.readStream.schema("run_id string, seq long, ts timestamp, stage string, status string").json(f"{tmp_path}/log/1")
    got = []
    query = T.live_state(log).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda rows, _: got.extend(rows.collect())).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][-1]["numRowsTotal"] <= 4
    # a null among them costs the numbers beside it no digits
    assert {(r["run_id"], r["stage"], r["seq"]) for r in got} == {(f"r{i}", "pipeline_done" if i == 7 else "ocr", 9007199254740993 + i) for i in range(200)} | {("r0", "gate", None)}


def test_a_family_whose_chunks_are_more_rows_than_its_lists_is_taken_apart(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 10)
    monkeypatch.setattr(J, "APART", 100)
    chain = [(s, c) for s in range(199) for c in (s, s + 1)] + [(500, c) for c in range(0, 60, 2)]  # one family of 200 classes
    few = [(1000 + f, 1000 + 3 * f + k) for f in range(5) for k in range(3)]
    lists = spark.createDataFrame(chain + few, "sig long, class long")
    rows, members = J._family_rows(lists, spark.createDataFrame([(2, 0), (0, 0)], "class long, component long"))
    groups = J._grouped(rows, ["family", "i", "j"], 4).collect()
    assert members < 500 and len(groups) < 800  # 200 classes in 20 chunks by 20 would be 8,000 rows
    found: dict = {}
    for r in groups:
        asks, answers = found.setdefault((r["bucket"], r["family"], r["i"], r["j"]), (set(), set()))
        asks |= {r["class"]} if r["asks"] else set()
        answers |= {r["class"]} if r["answers"] else set()
    meet = {(a, b) for asks, answers in found.values() for a in asks for b in answers}
    every: dict = {}
    for s, c in chain + few:
        every.setdefault(s, []).append(c)
    assert all((a, b) in meet or (b, a) in meet for cs in every.values() for a in cs for b in cs if a < b and (a, b) != (0, 2))
    assert max(len(a | b) for k, (a, b) in found.items() if k[0] is None) < 50


def test_links_are_found_in_families_taken_apart(spark, monkeypatch):
    rnd = random.Random(4)
    passages = [" ".join(f"p{i}w{k}" for k in range(40)) for i in range(6)]
    texts = []
    for d in range(240):  # unrelated words around common passages, and near copies of some rows
        own = [f"u{d}x{k}" for k in range(60)]
        texts.append(" ".join([*own[:30], *rnd.sample(passages, 2), *own[30:]]))
        if d % 4 == 0:
            copy = texts[-1].split()
            copy[rnd.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(s.tolist()) for s in J.shingle_sets(texts, 4)]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for name, value in (("CHUNK", 10), ("APART", 1), ("HOT", 3)):
        monkeypatch.setattr(J, name, value)
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) < len(texts)


def test_slices_of_the_audit_come_in_small_row_groups_and_stay_in_their_task(spark, monkeypatch):
    plans, paths, written = {}, [], A.materialise
    monkeypatch.setattr(A, "materialise", lambda df, label, *a, **k: (plans.update({label: df._jdf.queryExecution().executedPlan().toString()}), written(df, label, *a, **k))[1])
    monkeypatch.setattr(C, "new_path", lambda s, label, new=C.new_path: (paths.append(new(s, label)), paths[-1])[1])
    monkeypatch.setattr(A, "SLICE_BYTES", 1 << 16)
    monkeypatch.setitem(A.ROW_GROUPS, "parquet.block.size", 1 << 18)
    texts = [(d, "a", " ".join(f"w{d}x{k}" for k in range(20_000))) for d in range(24)]
    checks = A.document_checks(spark.createDataFrame(texts, "doc_id long, source string, text string").coalesce(1)).collect()
    assert {(r["n_words"], r["n_distinct"], r["fails"]) for r in checks} == {(20_000, 20_000, "")} and len(checks) == 24
    assert "MapInArrow" not in plans["document-checks"].split("Parquet")[0]
    groups = [g for f in glob.glob(f"{next(p for p in paths if 'term-slices' in p)}/**/*.parquet", recursive=True) for g in [pq.ParquetFile(f).metadata.row_group(i) for i in range(pq.ParquetFile(f).num_row_groups)]]
    assert len(groups) > 5 and max(g.total_byte_size for g in groups) < 4 << 20


def test_a_word_and_its_separator_are_one_row(spark):
    texts = ["red, of  zzz", " 12 red2-", "", None, "red2red of2", "--", "of"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lexicon = spark.createDataFrame([("red", "rot", 3, 1)], "jawi string, rumi string, n long, ord int")
    placed = L._words_with_separators(docs, LATIN, True)
    assert placed.groupBy("doc_id").count().agg(F.sum("count")).head()[0] == 3 + 2 + 3 + 1 + 1
    got = {r["doc_id"]: (r["text"], r["word_count"], r["unknown_count"], [(c["at"], c["jawi"]) for c in r["case_log"] or []]) for r in L.romanise(docs, lexicon, LATIN, composed=True).collect()}
    assert got == {
        0: ("rot, von  ⟦zzz⟧", 3, 1, [(4, "zzz")]), 1: (" 12 rot-rot-", 1, 0, []), 2: ("", 0, 0, []), 3: ("", 0, 0, []),
        4: ("rot-rotrot von-von", 3, 0, []), 5: ("--", 0, 0, []), 6: ("von", 1, 0, []),
    }
