"""Registered queries on agreement, error rates and corpus metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions import text as X
from ..operators import metrics as M
from .inputs import READING_PAIRS, SQL_BYTES, reading_pairs, table


def _pairs(spark, sf_dir):
    return reading_pairs(spark, sf_dir).select("doc_id", "article_id", F.col("a").alias("ref"), F.col("b").alias("hyp"))


def agreement_gate(spark, sf_dir):
    g = D.agreement_gate(F.col("ref"), F.col("hyp"), F.lit(0.5), composed=True)
    return _pairs(spark, sf_dir).select("doc_id", g.alias("g")).select("doc_id", "g.agreement", "g.passed", "g.status", "g.reason")


def pair_cer(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", D.compute_cer(F.col("ref"), F.col("hyp")).alias("cer"))


def corpus_cer(spark, sf_dir):
    return M.corpus_cer(_pairs(spark, sf_dir), "article_id")


def letter_errors(spark, sf_dir):
    return M.letter_errors(_pairs(spark, sf_dir), "aeht")


def pairwise_methods(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("item"), F.concat_ws("-", "role", (F.col("turn") % 2).cast("string")).alias("method"), "text")
    return M.pairwise_methods(turns)


def _entities(spark, sf_dir):
    words = F.filter(F.split(X.collapse(F.coalesce("text", F.lit(""))), " "), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    half = F.ceil(F.size("w") / 2).cast("int")
    people = lambda lo: F.filter("w", lambda x, i: (i % 2 == lo))
    first = F.slice("w", F.lit(1), F.greatest(half, F.lit(0)))
    return docs.select(F.struct(first.alias("people"), people(0).alias("places")).alias("prediction"), F.struct(people(0).alias("people"), first.alias("places")).alias("gold"))


def entity_scores(spark, sf_dir):
    return M.entity_scores(_entities(spark, sf_dir), ["people", "places"])


def rubric_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("item_id"), F.concat(F.lit("r"), F.col("l_suppkey") % 3).alias("rater"), (1 + F.col("l_quantity").cast("long") % 5).cast("string").alias("adequacy"), (1 + F.col("l_linenumber").cast("long") % 5).cast("string").alias("fluency")
    )
    return M.rubric_summary(rows)


def bleu(spark, sf_dir):
    return M.corpus_bleu(_pairs(spark, sf_dir))


def chrf(spark, sf_dir):
    return M.corpus_chrf(_pairs(spark, sf_dir))


def rouge(spark, sf_dir):
    return M.rouge(_pairs(spark, sf_dir))


def text_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.text_stats(F.col("text")).alias("s")).select("doc_id", "s.*")


def method_benchmark(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 50).alias("image"), F.col("role").alias("method"), X.text_stats(F.col("text")).alias("s"), (F.col("turn") / 10).alias("seconds"))
    rows = t.select("image", "method", "seconds", "s.chars", "s.words", "s.lines", (F.col("s.words") / (1.0 + F.col("s.chars"))).alias("confidence"), (F.col("s.chars") / 4.0 * 0.6 / 1e6).alias("cost"))
    return M.method_benchmark(rows)


def setting_sweep(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select((F.col("doc_id") % 4 / 10).alias("pad_x"), (F.col("doc_id") % 2 / 20).alias("pad_y"), D.measured(F.col("ref"), F.col("hyp")).alias("m")).select("pad_x", "pad_y", "m.edits", F.col("m.a_chars").alias("chars"))
    return M.best_setting(rows, ["pad_x", "pad_y"])


def review_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("review_target"), F.col("o_orderstatus").alias("status"), (1 + F.col("o_orderkey") % 5).alias("rating"))
    return M.review_counts(rows)


def latest_output(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("ocr_result_id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at"), F.col("event_id").alias("output_id"), F.col("value").alias("output"))
    return M.latest_output(rows).select("ocr_result_id", "kind", "output_id", "output")


def entity_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.normalise_entity(F.concat(F.lit("  "), "p_name", F.lit(" \n X"))).alias("entity"), X.slug(F.col("p_type")).alias("slug"))


def repeated_runs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.new_repeat_run(F.coalesce("text", F.lit("")), F.lit("#####")).alias("repeats"), F.round(X.script_fraction(F.col("text"), "a-z"), 9).alias("latin_share"))


NORM = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '\s+', ' ', 'g'))"
DISTANCE = f"levenshtein({SQL_BYTES.format(c='{a}')}, {SQL_BYTES.format(c='{b}')})"
SCORED = f"""{READING_PAIRS}, n AS (SELECT doc_id, {NORM.format(c='a')} AS x, {NORM.format(c='b')} AS y FROM pairs), g AS (
  SELECT doc_id, round(CASE WHEN greatest(length(x), length(y)) = 0 THEN 0.0::DOUBLE ELSE 1 - {DISTANCE.format(a='x', b='y')} / greatest(length(x), length(y)) END, 4) AS agreement FROM n)"""


def _gram_sql(tokens_h: str, tokens_r: str, orders: int) -> str:
    """Sums of clipped n-gram hits by grouping exploded grams."""
    grams = " UNION ALL ".join(
        f"SELECT doc_id, '{s}' AS side, {n} AS n, array_to_string(list_slice({t}, i, i + {n - 1}), chr(1)) AS gram FROM (SELECT doc_id, {t}, unnest(range(1, CAST(len({t}) - {n} + 2 AS BIGINT))) AS i FROM toks WHERE len({t}) >= {n}) AS u{s}{n}"
        for n in range(1, orders + 1)
        for s, t in (("h", "h"), ("r", "r"))
    )
    return f"""toks AS (SELECT doc_id, {tokens_h} AS h, {tokens_r} AS r FROM whole),
    grams AS ({grams}),
    counts AS (SELECT doc_id, n, gram, count(*) FILTER (side = 'h') AS ch, count(*) FILTER (side = 'r') AS cr FROM grams GROUP BY doc_id, n, gram),
    sums AS (SELECT n, sum(least(ch, cr)) AS hit, sum(ch) AS hyp, sum(cr) AS ref FROM counts GROUP BY n)"""


PAIRED = f"{READING_PAIRS}, whole AS (SELECT doc_id, a AS ref, b AS hyp FROM pairs)"
PUNCT = r"regexp_replace({c}, '([\{{-\~\[-\x60 -\&\(-\+\:-\@\/])', ' \1 ', 'g')"


def _13a(c: str) -> str:
    t = PUNCT.format(c=c)
    t = rf"regexp_replace({t}, '([^0-9])([\.,])', '\1 \2 ', 'g')"
    t = rf"regexp_replace({t}, '([\.,])([^0-9])', ' \1 \2', 'g')"
    return rf"list_filter(regexp_split_to_array(regexp_replace({t}, '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda w: w <> '')"


BLEU = f"""WITH {PAIRED}, {_gram_sql(_13a('hyp'), _13a('ref'), 4)}, lens AS (SELECT sum(len(h)) AS hl, sum(len(r)) AS rl FROM toks)
SELECT round(100 * CASE WHEN hl < rl THEN exp(1 - rl / hl) ELSE 1 END * exp((SELECT sum(ln(hit / hyp)) FROM sums) / 4), 6) AS bleu, CAST(hl AS BIGINT) AS hyp_len, CAST(rl AS BIGINT) AS ref_len,
  {', '.join(f'CAST((SELECT hit FROM sums WHERE n = {n}) AS BIGINT) AS hit_{n}' for n in range(1, 5))} FROM lens"""
CHARS = r"list_filter(string_split(regexp_replace({c}, '\s+', '', 'g'), ''), lambda x: x <> '')"
CHRF = f"""WITH {PAIRED}, {_gram_sql(CHARS.format(c='hyp'), CHARS.format(c='ref'), 6)}, pr AS (SELECT avg(hit / hyp) AS p, avg(hit / ref) AS r FROM sums WHERE hyp > 0 AND ref > 0)
SELECT round(100 * 5 * p * r / (4 * p + r), 6) AS chrf, {', '.join(f'CAST((SELECT hit FROM sums WHERE n = {n}) AS BIGINT) AS hit_{n}' for n in range(1, 7))} FROM pr"""
PRF = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r"

QUERIES = {
    "agreement_gate": (
        agreement_gate,
        f"""WITH {SCORED} SELECT doc_id, agreement, agreement >= 0.85 AS passed, CASE WHEN agreement >= 0.85 THEN 'passed' ELSE 'flagged' END AS status,
        CASE WHEN agreement >= 0.85 THEN printf('Methods A and B agree at %.1f%% (threshold 85%%).', round(100 * agreement, 1))
        ELSE printf('Methods A and B agree at only %.1f%% (threshold 85%%); flagged for human review. Method B dictionary covered 50.0%% of words, which may explain part of the gap.', round(100 * agreement, 1)) END AS reason FROM g""",
    ),
    "pair_cer": (
        pair_cer,
        f"""WITH {READING_PAIRS}, c AS (SELECT doc_id, trim(regexp_replace(a, '\\s+', ' ', 'g')) AS r, trim(regexp_replace(b, '\\s+', ' ', 'g')) AS h FROM pairs)
        SELECT doc_id, CASE WHEN r = '' THEN CASE WHEN h = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ELSE round({DISTANCE.format(a='r', b='h')} / length(r), 4) END AS cer FROM c""",
    ),
    "corpus_cer": (
        corpus_cer,
        f"""WITH {READING_PAIRS} SELECT article_id, CAST(sum({DISTANCE.format(a='a', b='b')}) AS BIGINT) AS edits, CAST(sum(length(a)) AS BIGINT) AS chars, round(sum({DISTANCE.format(a='a', b='b')}) / greatest(1, sum(length(a))), 6) AS cer,
        round(1 - sum({DISTANCE.format(a='a', b='b')}) / greatest(1, sum(length(a))), 6) AS accuracy FROM pairs GROUP BY ROLLUP (article_id)""",
    ),
    "letter_errors": (letter_errors, None),
    "pairwise_methods": (pairwise_methods, None),
    "entity_scores": (
        entity_scores,
        rf"""WITH d AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents),
        s AS (SELECT list_distinct(list_transform(list_slice(w, 1, CAST(ceil(len(w) / 2) AS BIGINT)), lambda x: lower(x))) AS f, list_distinct(list_transform(list_filter(w, lambda x, i: i % 2 = 1), lambda x: lower(x))) AS o FROM d),
        c AS (SELECT 'people' AS field, len(list_intersect(f, o)) AS tp, len(f) - len(list_intersect(f, o)) AS fp, len(o) - len(list_intersect(f, o)) AS fn FROM s
              UNION ALL SELECT 'places', len(list_intersect(f, o)), len(o) - len(list_intersect(f, o)), len(f) - len(list_intersect(f, o)) FROM s),
        t AS (SELECT field, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c GROUP BY GROUPING SETS ((field), ())), q AS (SELECT *, {PRF} FROM t)
        SELECT field, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM q""",
    ),
    "rubric_summary": (
        rubric_summary,
        """WITH r AS (SELECT l_orderkey, 'r' || (l_suppkey % 3) AS rater, 1 + CAST(l_quantity AS BIGINT) % 5 AS a, 1 + CAST(l_linenumber AS BIGINT) % 5 AS f FROM lineitem)
        SELECT count(*) AS ratings, count(DISTINCT l_orderkey) AS items, string_agg(DISTINCT rater, ',' ORDER BY rater) AS raters, round(avg(a), 6) AS adequacy_mean, round(stddev_samp(a), 6) AS adequacy_stdev, round(avg(f), 6) AS fluency_mean, round(stddev_samp(f), 6) AS fluency_stdev FROM r""",
    ),
    "corpus_bleu": (bleu, BLEU),
    "corpus_chrf": (chrf, CHRF),
    "rouge": (rouge, None),
    "text_stats": (
        text_stats,
        r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, trim(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f]+', ' ', 'g')) AS c FROM documents)
        SELECT doc_id, length(t) AS chars, CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS words, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + 1 END AS lines FROM t""",
    ),
    "method_benchmark": (
        method_benchmark,
        r"""WITH t AS (SELECT conv_id % 50 AS image, role AS method, turn / 10 AS seconds, coalesce(text, '') AS t, trim(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f]+', ' ', 'g')) AS c FROM conversations),
        s AS (SELECT image, method, seconds, length(t) AS chars, CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS words, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + 1 END AS lines FROM t)
        SELECT image, method, count(*) AS runs, round(avg(seconds), 6) AS seconds, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(words) AS BIGINT) AS words, CAST(sum(lines) AS BIGINT) AS lines, round(avg(words / (1.0::DOUBLE + chars)), 6) AS confidence, round(sum(chars / 4.0::DOUBLE * 0.6::DOUBLE / 1e6), 9) AS cost
        FROM s GROUP BY GROUPING SETS ((image, method), (method))""",
    ),
    "setting_sweep": (
        setting_sweep,
        f"""WITH {READING_PAIRS}, s AS (SELECT doc_id % 4 / 10 AS pad_x, doc_id % 2 / 20 AS pad_y, {DISTANCE.format(a='a', b='b')} AS e, length(a) AS c FROM pairs), g AS (SELECT pad_x, pad_y, round(sum(e) / sum(c), 6) AS cer, count(*) AS pages FROM s GROUP BY 1, 2)
        SELECT *, row_number() OVER (ORDER BY cer, pad_x, pad_y) = 1 AS best FROM g""",
    ),
    "review_counts": (review_counts, "SELECT o_orderpriority AS review_target, o_orderstatus AS status, count(*) AS reviews, round(avg(1 + o_orderkey % 5), 6) AS rating FROM orders GROUP BY 1, 2"),
    "latest_output": (
        latest_output,
        "SELECT user_id AS ocr_result_id, event_type AS kind, event_id AS output_id, value AS output FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) AS e WHERE k = 1",
    ),
    "entity_text": (
        entity_text,
        "SELECT p_partkey, lower(p_name) || ' x' AS entity, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part",
    ),
    "repeated_runs": (repeated_runs, None),
}
