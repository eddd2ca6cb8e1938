"""Registered queries on run records, JSON answers, reading order, plug-ins, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from ..functions.distance import agreement_gate
from ..operators import plugins as P
from ..operators import reading_order as O
from ..operators import runs as R
from ..sources import readers, writers
from ..sources.store import new_folder
from ..streaming import journal as J
from ..streaming import runs as T
from .inputs import GOLD_LINES, PREDICTED_LINES, RUN_EVENTS, gold_lines, predicted_lines, reading_pairs, run_events, table
from .metrics_plans import SCORED


def stage_states(spark, sf_dir):
    return R.latest_stage_states(run_events(spark, sf_dir)).select("run_id", "stage", "seq", "status")


def run_status(spark, sf_dir):
    stages = R.latest_stage_states(run_events(spark, sf_dir))
    status = F.when(F.col("duration") > 95, "failed_timeout").when((F.col("stage") == "purchase") & (F.col("duration") < 10), "skipped").otherwise(F.col("status"))
    return R.run_status(stages.withColumn("status", status), gate="purchase")


def stage_times(spark, sf_dir):
    return R.stage_times(run_events(spark, sf_dir))


def events_since(spark, sf_dir):
    return R.numbered_events(run_events(spark, sf_dir), 2).select("run_id", "seq", "idx")


def hot_runs(spark, sf_dir):
    runs = run_events(spark, sf_dir).groupBy("run_id").agg(F.max_by("status", "seq").alias("status"), F.min("ts").alias("created_at"))
    return R.hot_runs(runs).select("run_id", "status")


def interrupted_runs(spark, sf_dir):
    e = run_events(spark, sf_dir).withColumn("stage", F.when(F.col("stage") == "purchase", "pipeline_done").otherwise(F.col("stage")))
    return R.interrupted_runs(e, F.lit("2024-01-20 00:00:00").cast("timestamp"), "1 day").select("run_id", "status")


def _ocr_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("run_id"), F.col("l_linenumber").alias("page"), F.when(F.col("l_partkey") % 7 > 0, F.col("l_quantity") / 50).alias("confidence"), F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.col("l_partkey").cast("string")).alias("text"), F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"))


def ocr_page_summary(spark, sf_dir):
    return R.ocr_page_summary(_ocr_lines(spark, sf_dir))


def ocr_run_summary(spark, sf_dir):
    """Page records of which every ninth page failed and has no lines."""
    lines = _ocr_lines(spark, sf_dir)
    bad = (F.col("run_id") + F.col("page")) % 9 == 0
    pages = lines.groupBy("run_id", "page").agg(F.collect_list(F.struct("text", "confidence")).alias("lines"))
    return R.ocr_run_summary(pages.select("run_id", "page", F.when(bad, "failed_timeout").otherwise("completed").alias("status"), F.when(~bad, F.col("lines")).alias("lines")))


def romanisation_reviews(spark, sf_dir):
    """Gates of chat turns against their edited copies; every fifth has no second reading and so no gate."""
    pairs = reading_pairs(spark, sf_dir)
    gate = R.gate_or_skipped(F.when(F.col("doc_id") % 5 > 0, agreement_gate(F.col("a"), F.col("b"), composed=True)))
    return pairs.select("doc_id", gate.alias("g")).groupBy("g.status", "g.needs_review").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g.reason") == R.NO_GATE).alias("skipped"))


def answered_references(spark, sf_dir):
    """Orders as references and their lines of one mode as outputs: pairs, and references that have none."""
    golds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit("RAIL").alias("kind"), "o_orderpriority")
    outputs = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("doc"), F.when(F.col("l_partkey") % 3 == 0, "RAIL").otherwise("SHIP").alias("kind"), "l_partkey")
    pairs, lone = R.unmatched_references(outputs, golds, ["doc", "kind"])
    count = lambda rows, what: rows.groupBy("o_orderpriority").agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    return count(pairs, "paired").unionByName(count(lone, "lone"))


def article_text(spark, sf_dir):
    return R.article_text(_ocr_lines(spark, sf_dir)).select("run_id", F.md5(F.col("text").cast("binary")).alias("md5"))


def stage_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    out = R.stage_outcome(F.when(F.col("value") > 20, "text").otherwise(" "), F.when(F.col("event_type") == "error", "boom"), F.col("value") > 95)
    return e.groupBy(out.alias("status"), R.gate_stage_status(F.when(F.col("value") > 50, "passed").otherwise("flagged")).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def routed_texts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.route(F.col("text")).alias("r")).select("conv_id", "turn", "r.*")


def input_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 9 > 0, "pdf")
    status = S.input_status(F.when(F.col("doc_id") % 11 > 0, F.col("text")), F.col("doc_id") % 30, F.length("text"), kind, 6000, 25, 9000)
    return d.select("doc_id", status.alias("status"))


def event_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = F.try_parse_json(S.json_object_text(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))))
    return e.select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"))


def knowledge_checks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("w", F.coalesce("text", F.lit("")))
    none, one = F.array().cast("array<string>"), F.array("w")
    fields = [F.array("w", F.lit(" ")).alias("people"), none.alias("places"), F.col("w").alias("dates"), one.alias("organizations"), one.alias("themes")]
    kind = F.col("conv_id") % 3
    body = F.when(kind == 0, F.to_json(F.struct(*fields, none.alias("key_claims")))).when(kind == 1, F.to_json(F.struct(*fields, F.array(F.struct(F.lit(1).alias("a"))).alias("key_claims")))).otherwise(F.to_json(F.struct(*fields)))
    k = S.validate_knowledge(F.concat(F.lit("Here: "), body))
    return c.select("conv_id", "turn", k.alias("k")).select("conv_id", "turn", "k.valid", "k.reason", F.size("k.fields.people").alias("people"), F.size("k.fields.dates").alias("dates"))


def chat_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    answer = lambda content, finish="stop": F.to_json(F.struct(F.array(F.struct(F.lit(finish).alias("finish_reason"), F.struct(content.alias("content")).alias("message"))).alias("choices")))
    plain, cut = answer(text), answer(F.lit(""), "length")
    parts = F.replace(answer(F.array(text, F.lit("@part"))), F.lit('"@part"'), F.lit('{"text":"!"}'))
    m = S.message_text(F.when(F.col("turn") % 4 == 0, plain).when(F.col("turn") % 4 == 1, parts).when(F.col("turn") % 4 == 2, cut).otherwise(F.lit('{"choices":[]}')))
    return c.select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", "m.text", "m.error")


def verified_evidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    quote = lambda c: F.struct(F.lit("e").alias("entity"), c.alias("quote"))
    kept = S.verified_evidence(F.array(quote(F.substring("text", 3, 30)), quote(F.upper(F.substring("text", 3, 30))), quote(F.lit("no such words"))), F.col("text"))
    return d.select("doc_id", F.size(kept).cast("long").alias("kept"))


VERIFIED_EVIDENCE = r"""
WITH d AS (SELECT doc_id, text, trim(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f]+', ' ', 'g')) AS hay FROM documents),
q AS (SELECT doc_id, hay, trim(regexp_replace(unnest([substr(text, 3, 30), upper(substr(text, 3, 30)), 'no such words']), '[\s\x1c-\x1f]+', ' ', 'g')) AS quote FROM d)
SELECT doc_id, count_if(quote <> '' AND contains(hay, quote)) AS kept FROM q GROUP BY doc_id
"""


def token_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", (-F.col("l_discount")).alias("p"), (F.col("l_suppkey") % 4).cast("int").alias("id")))).alias("t"))
    return rows.select("l_orderkey", S.token_confidence(F.transform("t", lambda x: x["p"]), F.transform("t", lambda x: x["id"]), 3).alias("confidence"))


def cost_estimates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(S.estimate_cost(F.when(F.col("p_size") % 2 == 0, "vision-mini").otherwise("vision"), F.col("p_partkey") * 100, F.length("p_name"), F.col("p_size")), 12).alias("cost"))


def fallback_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a, b = F.when(F.col("turn") % 3 == 0, " "), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("b"), F.col("turn").cast("string")))
    return c.select("conv_id", "turn", S.fallback(a, b, F.lit("input")).alias("text"))


def run_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    run = F.when(F.col("event_id") % 3 == 0, F.md5(F.col("event_id").cast("string").cast("binary"))).otherwise(F.col("event_id").cast("string"))
    i = S.issue_of(F.concat(F.date_format("ts", "yyyy_MM"), F.lit("_001")))
    return e.select("event_id", S.valid_run_id(run).alias("valid"), i.alias("i")).select("event_id", "valid", "i.issue", "i.year", "i.in_range")


def saved_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    kind = F.col("doc_id") % 5
    provider = F.when(kind == 0, "Provider: Kraken\n").otherwise("")
    mark = F.when(kind == 3, "Jawi OCR Result\n").otherwise("")
    p = X.parse_saved_text(F.concat(F.lit("=== OCR ===\n"), mark, F.col("text"), F.lit("\n=== Metadata ===\n"), provider, F.lit("Page-No: 1\nPage-No: "), F.col("doc_id").cast("string")))
    name = F.when(kind == 1, "a_Qwen_1.txt").when(kind == 2, "OCR_output.txt").otherwise("plain.txt")
    return d.select("doc_id", p.alias("p"), name.alias("name"), F.concat(mark, "text").alias("t")).select("doc_id", F.length("p.text").alias("chars"), F.col("p.metadata")["page_no"].alias("page_no"), X.infer_provider(F.col("p.metadata"), F.col("name"), F.col("t")).alias("provider"))


def line_names(spark, sf_dir):
    g = gold_lines(spark, sf_dir)
    return g.select("page_id", "idx", X.page_key(F.lit("1950_01_001"), F.col("idx").cast("int")).alias("page_key"), X.crop_name(F.lit("a"), F.col("idx").cast("int"), F.col("idx").cast("int")).alias("crop"), X.article_of_title(F.concat(F.lit("Sheet 1950_01_00"), F.col("idx").cast("string"), F.lit(" DONE"))).alias("article"), X.spreadsheet_id(F.concat(F.lit("https://x/d/ab-"), F.col("idx").cast("string"), F.lit("/edit"))).alias("sheet"))


def file_types(spark, sf_dir):
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("255044462D", "89504E470D0A1A0A00", "FFD8FFE0", "2550444600", "524946460000000057454250", "00112233")])
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", S.file_type(F.get(heads, (F.col("p_partkey") % 6).cast("int"))).alias("file_type"))


# --- reading order


def gap_groups(spark, sf_dir):
    g = gold_lines(spark, sf_dir)
    return O.gap_groups(g, ["page_id"], "y1", "y2", 30.0).select("page_id", "idx", "group")


def widest_bands(spark, sf_dir):
    return O.widest_band(gold_lines(spark, sf_dir), ["page_id"])


def page_gutters(spark, sf_dir):
    return O.gutters(gold_lines(spark, sf_dir), ["page_id"], 10.0)


def fixed_columns(spark, sf_dir):
    return O.fixed_columns(gold_lines(spark, sf_dir), ["page_id"], 500.0).select("page_id", "idx", "place")


def page_reading_order(spark, sf_dir):
    boxes = gold_lines(spark, sf_dir).drop("text").withColumn("page_width", F.lit(1200.0))
    return O.reading_order(boxes, ["page_id"]).select("page_id", "idx", "place")


def page_column_order(spark, sf_dir):
    return O.column_order(gold_lines(spark, sf_dir, by_page=True).drop("text"), ["page_id"]).select("page_id", "idx", "place")


def suppressed_boxes(spark, sf_dir):
    """Every page's second box gets a narrower one within it, which is less sure, surer or as sure."""
    p = predicted_lines(gold_lines(spark, sf_dir)).drop("text").fillna(1.0, ["conf"])
    conf = F.when(F.col("page_id") % 3 == 0, F.col("conf") / 2).when(F.col("page_id") % 3 == 1, F.col("conf") + 0.25).otherwise(F.col("conf"))
    inner = p.filter("idx = 1").select("page_id", (F.col("idx") + 100).alias("idx"), F.col("x1"), F.col("y1"), (F.col("x1") + 50).alias("x2"), "y2", conf.alias("conf"))
    return O.suppress_contained(p.unionByName(inner), ["page_id"]).select("page_id", "idx")


# --- plug-ins and files


def plugged_lines(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text")
    return P.romanise_lines(d, lambda lines: [x[::-1] for x in lines]).select("doc_id", F.md5(F.col("romanised").cast("binary")).alias("digest"))


def plugged_stage(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text")

    def stage(text: str) -> str:
        if len(text) % 7 == 0:
            raise ValueError("seven")
        return "" if len(text) % 5 == 0 else text[:10]

    first = P.text_stage(d, stage, "translate", attempts=2)
    return P.repaired(d, first, F.col("status") == "completed", lambda t: t[:3]).groupBy("status", "repaired").agg(F.count(F.lit(1)).alias("n"))


def split_files(spark, sf_dir):
    """Lines written as CSV per split and read back."""
    lines = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 10 == 0, "test").otherwise("train").alias("split"), F.concat("p_name", F.lit(".png")).alias("file_name"), F.col("p_type").alias("text"))
    path = new_folder(spark, "splits")
    writers.by_split(lines, path)
    back = spark.read.schema("file_name string, text string, split string").csv(path, header=True)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("text").alias("texts"))


def pair_files(spark, sf_dir):
    """Word pairs written as JSON arrays, one file a brand, and read back."""
    pairs = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.to_json(F.collect_list(F.array("p_name", "p_type"))).alias("value"))
    path = new_folder(spark, "pairs")
    pairs.repartition(8, "p_brand").sortWithinPartitions("p_brand").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.word_pairs(spark, path).groupBy(F.get("pair", F.lit(1)).alias("p_type")).agg(F.count(F.lit(1)).alias("pairs"))


def sheet_texts(spark, sf_dir):
    """Whole documents as cells of sheets, written, read back and cut in lines."""
    path = new_folder(spark, "sheets")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.write.option("escape", '"').option("emptyValue", "").csv(path)
    cells = readers.sheet_cells(spark, path, 2).groupBy("article_id", "row").agg(*(F.max(F.when(F.col("col") == k, F.col("value"))).alias(n) for k, n in enumerate(("id", "text"))))
    text = F.coalesce("text", F.lit(""))
    return cells.select(F.col("id").cast("long").alias("doc_id"), F.length(text).alias("chars"), F.sha2(text, 256).alias("digest"), F.size(F.split(text, "\n")).alias("lines"))


def kept_once(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.filter("o_orderkey % 4 = 0").select("o_custkey").distinct()
    return R.write_once(old, o.filter("o_orderkey % 4 = 1").select("o_custkey"), ["o_custkey"])


def order_templates(spark, sf_dir):
    out = writers.order_template_rows(gold_lines(spark, sf_dir), "page_id")
    return out.select("page_id", F.array_join(F.transform("order", lambda x: x.cast("string")), ",").alias("places"))


# --- streams


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    now = spark.read.parquet(path)
    stream = spark.readStream.schema(now.schema)
    # a stream follows a folder: the table's own, or the one that its only file is in
    alone = [f.rstrip("/").endswith("/events.parquet") for f in now.inputFiles()] == [True]
    e = (stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if alone else stream.parquet(path)).withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 80, "needs_review").otherwise("completed")
    return e.select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("run_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("stage"), status.alias("status"))


def _run(spark, stream, mode):
    path = new_folder(spark, "stream")
    T.to_table(stream, path, f"{path}-checkpoint", mode)
    return T.written(spark, path)


def stream_live_state(spark, sf_dir):
    return T.newest(_run(spark, T.live_state(_stream(spark, sf_dir)), "update"), ["run_id", "stage"])


def stream_throughput(spark, sf_dir):
    return _run(spark, T.throughput(_stream(spark, sf_dir)), "append").drop("batch").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_sliding(spark, sf_dir):
    return _run(spark, T.throughput(_stream(spark, sf_dir), "2 hours", "1 hour"), "append").drop("batch").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_deduplicated(spark, sf_dir):
    e = _stream(spark, sf_dir)
    rows = _run(spark, T.without_repeats(e.unionByName(e)), "append")
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("events"))


def stream_bursts(spark, sf_dir):
    rows = _run(spark, T.bursts(_stream(spark, sf_dir), "2 hours"), "append")
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("bursts"), F.sum("events").alias("events"))


def stream_interrupted(spark, sf_dir):
    rows = _run(spark, T.interrupted(_stream(spark, sf_dir), "12 hours", end_stage="purchase"), "append")
    return T.still_interrupted(rows).select("run_id", "status", "events")


def stream_complete_articles(spark, sf_dir):
    counts = run_events(spark, sf_dir).groupBy("run_id").agg(F.countDistinct("stage").alias("page_count"))
    rows = _run(spark, T.complete_articles(_stream(spark, sf_dir).withColumn("page", F.col("stage")), counts), "update")
    return T.newest(rows, ["run_id"]).select("run_id", "page_count")


def stream_replayed(spark, sf_dir):
    """What a reader gets that starts when half of the log is there: the log comes in two files."""
    log, out = new_folder(spark, "log"), new_folder(spark, "reader")
    events = run_events(spark, sf_dir).select("run_id", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "stage", "status")
    middle = events.agg(F.expr("percentile_approx(seq, 0.5)")).head()[0]
    first = F.coalesce(F.col("seq") <= middle, F.lit(False))
    # how far the second file's events lie behind the first's: none of them is late
    behind = events.agg(F.max(F.when(first, F.col("ts"))).alias("newest"), F.min(F.when(~first, F.col("ts"))).alias("oldest")).select(F.timestamp_diff("SECOND", "oldest", "newest")).head()[0]
    late = f"{max(600, (behind or 0) + 1)} seconds"
    numbered = lambda: J.numbered(spark.readStream.schema(events.schema).parquet(log), late, end_stage="purchase")
    for half in (first, ~first):
        events.filter(half).write.mode("append").parquet(log)
        J.keep(numbered(), f"{log}-journal", f"{log}-state").awaitTermination()
        J.follow(spark, f"{log}-journal", f"{out}-state", J.to_folder(out)).awaitTermination()
    return T.written(spark, out).select("run_id", "index", "seq", "stage")


def stream_gate(spark, sf_dir):
    s = _stream(spark, sf_dir).select("seq", F.col("stage").alias("a"), F.when(F.col("seq") % 2 == 0, F.col("stage")).otherwise(F.col("status")).alias("b"))
    return _run(spark, T.gated(s).select("seq", "gate.passed"), "append").groupBy("passed").agg(F.count(F.lit(1)).alias("n"))


CLOSED = "FROM run_events, (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM run_events) AS m"
SESSIONS = f"""{RUN_EVENTS}, cut AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL {{gap}} THEN 0 ELSE 1 END AS fresh FROM run_events WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq)),
sess AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY ts, seq) AS s FROM cut),
closed AS (SELECT run_id, s, count(*) AS events, bool_or(stage = 'purchase') AS ended FROM sess GROUP BY run_id, s HAVING max(ts) + INTERVAL {{gap}} <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM run_events))"""
LATEST = f"{RUN_EVENTS}, latest AS (SELECT run_id, stage, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(duration, seq) AS duration FROM run_events GROUP BY 1, 2)"
OCR = "ocr AS (SELECT l_orderkey % 500 AS run_id, l_linenumber AS page, CASE WHEN l_partkey % 7 > 0 THEN l_quantity / 50 END AS confidence, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS text, l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"
ONES = r"trim(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f]+', ' ', 'g'))"

QUERIES = {
    "run_stage_states": (stage_states, f"WITH {LATEST} SELECT run_id, stage, seq, status FROM latest"),
    "run_status": (
        run_status,
        f"""WITH {LATEST}, s AS (SELECT run_id, stage, duration, CASE WHEN duration > 95 THEN 'failed_timeout' WHEN stage = 'purchase' AND duration < 10 THEN 'skipped' ELSE status END AS status FROM latest),
        r AS (SELECT run_id, count(*) AS stages, coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (status = 'failed_timeout' AND stage <> 'error'), '') AS bad, bool_or(stage = 'error') AS broken, bool_or(stage = 'purchase' AND status IN ('needs_review', 'skipped')) AS review, round(sum(duration), 6) AS duration FROM s GROUP BY run_id),
        t AS (SELECT *, CASE WHEN broken THEN 'failed' WHEN bad <> '' OR review THEN 'needs_review' ELSE 'completed' END AS status FROM r)
        SELECT run_id, stages, status, bad AS incomplete_stages, status <> 'completed' AS needs_human_review, duration FROM t""",
    ),
    "run_stage_times": (stage_times, f"WITH {RUN_EVENTS} SELECT stage, count(*) AS runs, round(avg(duration), 6) AS mean, round(quantile_cont(duration, 0.5), 6) AS median, round(max(duration), 6) AS longest FROM run_events GROUP BY stage"),
    "run_events_since": (events_since, f"WITH {RUN_EVENTS} SELECT * FROM (SELECT run_id, seq, CAST(row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS INTEGER) AS idx FROM run_events) AS e WHERE idx >= 2"),
    "run_hot_runs": (hot_runs, f"WITH {RUN_EVENTS}, r AS (SELECT run_id, arg_max(status, seq) AS status, min(ts) AS created_at FROM run_events GROUP BY run_id) SELECT run_id, status FROM r ORDER BY created_at DESC, run_id DESC LIMIT 50"),
    "run_interrupted": (interrupted_runs, f"WITH {RUN_EVENTS} SELECT run_id, 'failed' AS status FROM run_events GROUP BY run_id HAVING NOT bool_or(stage = 'purchase') AND max(ts) < TIMESTAMP '2024-01-19 00:00:00'"),
    "ocr_page_summary": (ocr_page_summary, f"WITH {OCR} SELECT run_id, page, count(*) AS lines, round(avg(confidence), 6) AS mean_confidence, count_if(coalesce(confidence < 0.6::DOUBLE, false)) AS low_lines FROM ocr GROUP BY GROUPING SETS ((run_id, page), (run_id))"),
    "ocr_run_summary": (
        ocr_run_summary,
        f"""WITH {OCR}, l AS (SELECT run_id, page, (run_id + page) % 9 = 0 AS bad, confidence FROM ocr)
        SELECT run_id, page, count(DISTINCT page) AS pages, count(DISTINCT page) FILTER (bad) AS failed_pages, count(*) FILTER (NOT bad) AS lines, round(avg(confidence) FILTER (NOT bad), 6) AS mean_confidence, count_if(NOT bad AND coalesce(confidence < 0.6::DOUBLE, false)) AS low_lines
        FROM l GROUP BY GROUPING SETS ((run_id, page), (run_id))""",
    ),
    "romanisation_reviews": (
        romanisation_reviews,
        f"""WITH {SCORED}, s AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'skipped' WHEN agreement >= 0.85 THEN 'passed' ELSE 'flagged' END AS status FROM g)
        SELECT status, status <> 'passed' AS needs_review, count(*) AS n, count_if(status = 'skipped') AS skipped FROM s GROUP BY 1, 2""",
    ),
    "answered_references": (
        answered_references,
        """WITH o AS (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 3 = 0)
        SELECT o_orderpriority, 'paired' AS what, count(*) AS n FROM orders JOIN o ON l_orderkey = o_orderkey GROUP BY 1 UNION ALL SELECT o_orderpriority, 'lone', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM o) GROUP BY 1""",
    ),
    "ocr_article_text": (article_text, f"WITH {OCR}, p AS (SELECT run_id, page, string_agg(text, chr(10) ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice) AS text FROM ocr WHERE text <> '' GROUP BY 1, 2) SELECT run_id, md5(string_agg(text, chr(10) ORDER BY page)) AS md5 FROM p GROUP BY run_id"),
    "stage_outcomes": (stage_outcomes, "SELECT CASE WHEN value > 95 THEN 'failed_timeout' WHEN event_type = 'error' THEN 'failed_exception' WHEN value > 20 THEN 'completed' ELSE 'failed_empty_output' END AS status, CASE WHEN value > 50 THEN 'completed' ELSE 'needs_review' END AS gate, count(*) AS n FROM events GROUP BY 1, 2"),
    "routed_texts": (routed_texts, f"WITH c AS (SELECT conv_id, turn, {ONES} AS c FROM conversations), n AS (SELECT conv_id, turn, CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS n FROM c) SELECT conv_id, turn, n AS word_count, n >= 10 AS summarise, CASE WHEN n < 10 THEN 'Short snippet (' || n || ' words) — skipping summary agent' ELSE 'Full article (' || n || ' words) — running all 4 agents' END AS label FROM n"),
    "input_checks": (input_checks, r"SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 400 WHEN length(text) > 9000 THEN 413 WHEN doc_id % 30 > 25 THEN 413 WHEN doc_id % 11 > 0 AND length(text) > 6000 THEN 413 WHEN doc_id % 11 = 0 OR text IS NULL OR regexp_full_match(text, '\s*') THEN 400 END AS status FROM documents"),
    "json_event_props": (event_props, "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "json_knowledge_checks": (
        knowledge_checks,
        r"""WITH c AS (SELECT conv_id, turn, regexp_full_match(coalesce(text, ''), '\s*') AS blank FROM conversations) SELECT conv_id, turn, conv_id % 3 = 0 AS valid, CASE conv_id % 3 WHEN 1 THEN 'not a list of strings: key_claims' WHEN 2 THEN 'missing keys: key_claims' END AS reason,
        CASE WHEN conv_id % 3 = 0 THEN CASE WHEN blank THEN 0 ELSE 1 END END AS people, CASE WHEN conv_id % 3 = 0 THEN CASE WHEN blank THEN 0 ELSE 1 END END AS dates FROM c""",
    ),
    "json_chat_answers": (
        chat_answers,
        r"""WITH c AS (SELECT conv_id, turn, regexp_replace(coalesce(text, '') || CASE WHEN turn % 4 = 1 THEN '!' ELSE '' END, '^\s+|\s+$', '', 'g') AS t FROM conversations)
        SELECT conv_id, turn, CASE WHEN turn % 4 < 2 AND t <> '' THEN t END AS text, CASE WHEN turn % 4 = 3 THEN 'no_choices' WHEN turn % 4 = 2 THEN 'length_limit' WHEN t = '' THEN 'empty' END AS error FROM c""",
    ),
    "verified_evidence": (verified_evidence, VERIFIED_EVIDENCE),
    "token_confidence": (
        token_confidence,
        """WITH t AS (SELECT l_orderkey, -l_discount AS p, l_suppkey % 4 AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, -l_discount, l_suppkey % 4) AS k FROM lineitem), e AS (SELECT l_orderkey, min(k) FILTER (id = 3) AS stop FROM t GROUP BY 1)
        SELECT t.l_orderkey, round(least(1, exp(sum(p) / count(*))), 4) AS confidence FROM t JOIN e ON e.l_orderkey = t.l_orderkey AND k <= coalesce(stop, k) GROUP BY t.l_orderkey""",
    ),
    "cost_estimates": (cost_estimates, "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN round(((p_partkey * 100 / 750.0::DOUBLE + length(p_name) / 4.0::DOUBLE) * 0.15::DOUBLE + p_size / 4.0::DOUBLE * 0.6::DOUBLE) / 1e6, 12) END AS cost FROM part"),
    "fallback_texts": (fallback_texts, "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'b' || turn ELSE 'input' END AS text FROM conversations"),
    "run_ids_and_issues": (run_ids, "SELECT event_id, event_id % 3 = 0 AS valid, strftime(ts, '%Y_%m') AS issue, CAST(strftime(ts, '%Y') AS INTEGER) AS year, CAST(strftime(ts, '%Y') AS INTEGER) BETWEEN 1950 AND 1969 AS in_range FROM events"),
    "saved_texts": (saved_texts, r"SELECT doc_id, length(regexp_replace(CASE WHEN doc_id % 5 = 3 THEN 'Jawi OCR Result' || chr(10) ELSE '' END || coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS chars, CAST(doc_id AS VARCHAR) AS page_no, CASE doc_id % 5 WHEN 0 THEN 'kraken' WHEN 1 THEN 'qwen-fixture' WHEN 2 THEN 'tesseract' WHEN 3 THEN 'tesseract' ELSE 'text-fixture' END AS provider FROM documents"),
    "line_names": (line_names, f"WITH {GOLD_LINES} SELECT page_id, idx, printf('1950_01_001_p%02d', idx) AS page_key, printf('a_p%02d_line_%03d.png', idx, idx) AS crop, '1950_01_00' || idx AS article, 'ab-' || idx AS sheet FROM gold"),
    "file_types": (file_types, "SELECT p_partkey, ['pdf', 'png', 'jpg', NULL, NULL, NULL][CAST(p_partkey % 6 + 1 AS BIGINT)] AS file_type FROM part"),
    "order_gap_groups": (gap_groups, f"WITH {GOLD_LINES}, r AS (SELECT *, max(y2) OVER (PARTITION BY page_id ORDER BY y1, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM gold) SELECT page_id, idx, CAST(sum(CASE WHEN y1 - reach >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y1, idx) AS BIGINT) AS \"group\" FROM r"),
    "order_widest_bands": (widest_bands, f"WITH {GOLD_LINES}, r AS (SELECT *, y1 - max(y2) OVER (PARTITION BY page_id ORDER BY y1, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM gold), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY gap DESC, y1, idx) AS k FROM r WHERE gap > 0) SELECT page_id, gap, y1 AS at, idx FROM k WHERE k = 1"),
    "order_gutters": (page_gutters, None),
    "order_fixed_columns": (fixed_columns, f"WITH {GOLD_LINES} SELECT page_id, idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY (x1 + x2) / 2 < 500, (y1 + y2) / 2, idx) AS INTEGER) AS place FROM gold"),
    "order_reading": (page_reading_order, None),
    "order_columns": (page_column_order, None),
    "order_suppressed_boxes": (suppressed_boxes, f"WITH {GOLD_LINES}, {PREDICTED_LINES} SELECT page_id, CASE WHEN idx = 1 AND page_id % 3 = 1 THEN 101 ELSE idx END AS idx FROM pred"),
    "plugin_lines": (plugged_lines, "SELECT conv_id * 100 + turn AS doc_id, md5(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: CASE WHEN trim(x) = '' THEN x ELSE reverse(x) END), chr(10))) AS digest FROM conversations"),
    "plugin_stage": (plugged_stage, "SELECT CASE WHEN length(coalesce(text, '')) = 0 THEN 'failed_empty_output' ELSE 'completed' END AS status, length(coalesce(text, '')) % 7 = 0 OR length(coalesce(text, '')) % 5 = 0 AS repaired, count(*) AS n FROM conversations GROUP BY 1, 2"),
    "files_by_split": (split_files, "SELECT CASE WHEN p_partkey % 10 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS lines, count(DISTINCT p_type) AS texts FROM part GROUP BY 1"),
    "files_sheet_cells": (sheet_texts, "SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(coalesce(text, '')) AS digest, len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents"),
    "files_word_pairs": (pair_files, "SELECT p_type, count(*) AS pairs FROM part GROUP BY 1"),
    "files_written_once": (kept_once, "SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 4 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 4 = 0)"),
    "files_order_templates": (order_templates, f"WITH {GOLD_LINES}, n AS (SELECT page_id, count(*) AS n FROM gold GROUP BY 1) SELECT page_id, array_to_string(range(0, n), ',') AS places FROM n"),
    "stream_live_state": (stream_live_state, f"WITH {LATEST} SELECT run_id, stage, seq, status FROM latest"),
    "stream_throughput": (stream_throughput, f"WITH {RUN_EVENTS} SELECT date_trunc('hour', ts) AS start, count(*) AS events, count_if(status = 'failed') AS failed {CLOSED} GROUP BY 1, mark HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark"),
    "stream_sliding_throughput": (stream_sliding, f"WITH {RUN_EVENTS}, w AS (SELECT date_trunc('hour', ts) - to_hours(k) AS start, status, mark {CLOSED}, (VALUES (0), (1)) AS s(k)) SELECT start, count(*) AS events, count_if(status = 'failed') AS failed FROM w GROUP BY start, mark HAVING start + INTERVAL 2 HOUR <= mark"),
    "stream_deduplicated": (stream_deduplicated, "SELECT event_type AS stage, count(*) AS events FROM events GROUP BY 1"),
    "stream_bursts": (stream_bursts, f"WITH {SESSIONS.format(gap='2 HOUR')} SELECT run_id, count(*) AS bursts, CAST(sum(events) AS BIGINT) AS events FROM closed GROUP BY run_id"),
    "stream_interrupted": (stream_interrupted, f"WITH {SESSIONS.format(gap='12 HOUR')} SELECT run_id, 'failed' AS status, CAST(sum(events) AS BIGINT) AS events FROM closed GROUP BY run_id HAVING NOT bool_or(ended)"),
    "stream_complete_articles": (stream_complete_articles, f"WITH {RUN_EVENTS} SELECT run_id, count(DISTINCT stage) AS page_count FROM run_events GROUP BY run_id"),
    "stream_replayed": (
        stream_replayed,
        f"""WITH {RUN_EVENTS}, ends AS (SELECT run_id, min(seq) FILTER (stage = 'purchase') AS last FROM run_events GROUP BY run_id)
            SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS index, seq, stage FROM run_events JOIN ends USING (run_id) WHERE last IS NULL OR seq <= last""",
    ),
    "stream_gate": (stream_gate, f"WITH {RUN_EVENTS} SELECT seq % 2 = 0 AS passed, count(*) AS n FROM run_events GROUP BY 1"),
}
