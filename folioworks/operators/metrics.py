"""Corpus metrics: character error rates, agreement, entity scores, ratings, BLEU, chrF and ROUGE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import gram_counts, lcs_words, measured, similarity_ratio, source_errors
from ..functions.scalars import safe_ratio
from ..functions.text import SPECIAL_LETTERS, normalise_entity


def paired(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Both sides joined on the key; a key that one side lacks, or no rows at all, is an error."""
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), key, "full")
    ok = F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit("hypotheses and references do not align"))
    return both.filter(F.coalesce(ok.cast("string"), F.lit("")) == "").drop("_l", "_r")


def corpus_cer(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """Edits over reference characters: per ``by`` value and over all (null), as sums and never as a mean of ratios."""
    r, h = F.coalesce("ref", F.lit("")), F.coalesce("hyp", F.lit(""))  # a text that is missing is an empty one
    rows = pairs.withColumn("_m", measured(r, h)).withColumns({"edits": F.col("_m.edits"), "chars": F.col("_m.a_chars")})
    grouped = rows.rollup(by) if by else rows.groupBy()
    out = grouped.agg(F.sum("edits").alias("edits"), F.sum("chars").alias("chars"))
    cer = F.col("edits") / F.greatest(F.lit(1), "chars")
    return out.withColumn("cer", F.round(cer, 6)).withColumn("accuracy", F.round(1 - cer, 6))


def letter_errors(pairs: DataFrame, letters: str = SPECIAL_LETTERS) -> DataFrame:
    """(letter, occurrences, errors, rate) of the given letters in the references."""
    wanted = F.array(*[F.lit(c) for c in letters])
    keep = lambda a: F.filter(a, lambda c: F.array_contains(wanted, c))
    met = pairs.select(F.explode(keep(F.split("ref", ""))).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("occurrences"))
    lost = pairs.select(F.explode(keep(source_errors(F.col("ref"), F.col("hyp")))).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("errors"))
    return met.join(lost, "letter", "left").select("letter", "occurrences", F.coalesce("errors", F.lit(0)).alias("errors"), F.round(F.coalesce("errors", F.lit(0)) / F.col("occurrences"), 6).alias("rate"))


def pairwise_methods(readings: DataFrame) -> DataFrame:
    """(item, method_a, method_b, similarity) of the methods of each item; ``readings`` has item, method, text."""
    a, b = readings.select("item", F.col("method").alias("method_a"), F.col("text").alias("a")), readings.select("item", F.col("method").alias("method_b"), F.col("text").alias("b"))
    return a.join(b, "item").filter("method_a < method_b").select("item", "method_a", "method_b", similarity_ratio(F.col("a"), F.col("b")).alias("similarity"))


def entity_scores(items: DataFrame, fields: list[str]) -> DataFrame:
    """Precision, recall and F1 per field and over all (field null). Items have prediction and gold structs of string arrays."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(c, normalise_entity), lambda x: x != ""))
    sides = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), clean(F.col(f"prediction.{f}")).alias("p"), clean(F.col(f"gold.{f}")).alias("g")) for f in fields]))
    rows = items.select(sides.alias("s")).select("s.field", F.size(F.array_intersect("s.p", "s.g")).alias("tp"), F.size(F.array_except("s.p", "s.g")).alias("fp"), F.size(F.array_except("s.g", "s.p")).alias("fn"))
    out = rows.groupingSets([["field"], []], "field").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select("field", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def rubric_summary(ratings: DataFrame, scales: tuple = ("adequacy", "fluency")) -> DataFrame:
    """Counts, raters, means and sample deviations of 1 to 5 ratings; a rating out of range is an error."""
    for s in scales:
        value = F.col(s).cast("double")
        ratings = ratings.withColumn(s, F.when(value.between(1, 5), value).otherwise(F.raise_error(F.lit(f"{s} out of 1 to 5")).cast("double")))
    stats = [f(s).alias(f"{s}_{name}") for s in scales for name, f in (("mean", lambda c: F.round(F.avg(c), 6)), ("stdev", lambda c: F.round(F.when(F.count(c) > 1, F.stddev_samp(c)), 6)))]
    return ratings.agg(F.count(F.lit(1)).alias("ratings"), F.countDistinct("item_id").alias("items"), F.array_join(F.sort_array(F.collect_set("rater")), ",").alias("raters"), *stats)


def gram_hits(pairs: DataFrame, key: str, hyp: Column, ref: Column, orders: int) -> DataFrame:
    """(key, n, hit, hyp, ref): grams of each order per pair. They are counted within the row, so only sums are shuffled."""
    return pairs.select(key, F.explode(gram_counts(hyp, ref, orders)).alias("x")).select(key, "x.*")


def tokens_13a(text: Column) -> Column:
    """Words with punctuation apart, as the default BLEU tokeniser splits them."""
    t = F.replace(F.replace(F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    t = F.regexp_replace(t, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    t = F.regexp_replace(F.regexp_replace(t, r"([^0-9])([\.,])", "$1 $2 "), r"([\.,])([^0-9])", " $1 $2")
    return F.filter(F.split(F.regexp_replace(t, r"([0-9])(-)", "$1 $2 "), r"\s+"), lambda w: w != "")


def gram_sums(pairs: DataFrame, key: str, hyp: Column, ref: Column, orders: int) -> DataFrame:
    """One row: hit_n, hyp_n and ref_n over all pairs for each order."""
    hits = gram_hits(pairs, key, hyp, ref, orders)
    return hits.agg(*[F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}_{n}") for n in range(1, orders + 1) for c in ("hit", "hyp", "ref")])


def corpus_bleu(pairs: DataFrame, orders: int = 4, key: str = "doc_id") -> DataFrame:
    """BLEU over all pairs with exponential smoothing of orders without hits; 0 if nothing hits or no text is long enough for
    an order."""
    s = gram_sums(pairs, key, tokens_13a(F.col("hyp")), tokens_13a(F.col("ref")), orders)
    logs, smooth = F.lit(0.0), F.lit(1.0)
    for n in range(1, orders + 1):
        empty = F.col(f"hit_{n}") == 0
        smooth = F.when(empty, smooth * 2).otherwise(smooth)
        logs = logs + F.log(F.when(empty, F.try_divide(F.lit(1.0), smooth * F.col(f"hyp_{n}"))).otherwise(F.try_divide(f"hit_{n}", f"hyp_{n}")))
    brevity = F.when(F.col("hyp_1") < F.col("ref_1"), F.exp(1 - F.try_divide("ref_1", "hyp_1"))).otherwise(1.0)
    score = F.when((F.col(f"hyp_{orders}") > 0) & (F.col("hit_1") > 0), F.round(100 * brevity * F.exp(logs / orders), 6)).otherwise(0.0)
    return s.select(score.alias("bleu"), F.col("hyp_1").alias("hyp_len"), F.col("ref_1").alias("ref_len"), *[f"hit_{n}" for n in range(1, orders + 1)])


def corpus_chrf(pairs: DataFrame, orders: int = 6, beta: float = 2.0, key: str = "doc_id") -> DataFrame:
    """chrF over all pairs: precision and recall of each character order, averaged over the orders that occur."""
    chars = lambda c: F.regexp_replace(F.col(c), r"\s+", "")
    s = gram_sums(pairs, key, chars("hyp"), chars("ref"), orders)
    used = [(F.col(f"hyp_{n}") > 0) & (F.col(f"ref_{n}") > 0) for n in range(1, orders + 1)]
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    count = total([u.cast("int") for u in used])
    mean = lambda den: total([F.when(u, F.try_divide(F.col(f"hit_{n}"), F.col(f"{den}_{n}"))).otherwise(0.0) for n, u in enumerate(used, 1)]) / F.nullif(count, F.lit(0))
    p, r = mean("hyp"), mean("ref")
    score = F.when((count > 0) & (p + r > 0), (1 + beta**2) * p * r / F.nullif(beta**2 * p + r, F.lit(0.0))).otherwise(0.0)
    return s.select(F.round(100 * score, 6).alias("chrf"), *[f"hit_{n}" for n in range(1, orders + 1)])


def rouge(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean F of ROUGE-1, ROUGE-2 and ROUGE-L over lower-case words of a-z and 0-9."""
    words = lambda c: F.regexp_extract_all(F.lower(F.col(c)), F.lit("[a-z0-9]+"), F.lit(0))

    def f(hits: Column, hyp: Column, ref: Column) -> Column:
        p, r = safe_ratio(hits, hyp), safe_ratio(hits, ref)
        return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)

    grams = gram_hits(pairs, key, words("hyp"), words("ref"), 2)
    per = grams.groupBy(key).agg(*[F.sum(F.when(F.col("n") == n, f(F.col("hit"), F.col("hyp"), F.col("ref")))).alias(f"f{n}") for n in (1, 2)])
    rows = pairs.select(key, words("hyp").alias("h"), words("ref").alias("r")).withColumn("f3", f(lcs_words(F.col("h"), F.col("r")), F.size("h"), F.size("r"))).join(per, key, "left")
    return rows.agg(F.count(F.lit(1)).alias("pairs"), *[F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(name) for c, name in (("f1", "rouge1"), ("f2", "rouge2"), ("f3", "rouge_l"))])


def method_benchmark(runs: DataFrame) -> DataFrame:
    """Per (image, method) and per method (image null): runs, seconds, characters, words, lines, confidence, cost."""
    out = runs.groupingSets([["image", "method"], ["method"]], "image", "method").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("seconds"), 6).alias("seconds"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.sum("lines").alias("lines"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.sum("cost"), 9).alias("cost")
    )
    return out


def best_setting(sweep: DataFrame, settings: list[str], edits: str = "edits", chars: str = "chars") -> DataFrame:
    """Error rate per setting and which setting has the least (ties: the first in order)."""
    per = sweep.groupBy(*settings).agg(F.round(F.sum(edits) / F.sum(chars), 6).alias("cer"), F.count(F.lit(1)).alias("pages"))
    best = per.agg(F.min(F.struct("cer", *settings)).alias("b")).select(*[F.col(f"b.{s}").alias(f"_{s}") for s in settings])
    same = reduce(lambda a, b: a & b, [F.col(s) == F.col(f"_{s}") for s in settings])
    return per.join(F.broadcast(best), same, "left").select(*settings, "cer", "pages", F.col(f"_{settings[0]}").isNotNull().alias("best"))


def review_counts(reviews: DataFrame) -> DataFrame:
    """Reviews and mean rating per target and status."""
    return reviews.groupBy("review_target", "status").agg(F.count(F.lit(1)).alias("reviews"), F.round(F.avg("rating"), 6).alias("rating"))


def latest_output(outputs: DataFrame, key: str = "ocr_result_id") -> DataFrame:
    """The newest output of each key and kind."""
    w = Window.partitionBy(key, "kind").orderBy(F.desc("created_at"), F.desc("output_id"))
    return outputs.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
