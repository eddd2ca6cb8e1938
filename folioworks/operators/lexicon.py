"""Word lexicon from aligned script pairs, and transliteration of corpora with it.

Words are resolved once per distinct word and joined back to their places, so frequent words cost one lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import JAWI, Script, clean_pair, consonant_skeleton, normalise_script, normalise_separator, once, spelling_variants, tokens
from ..sources.store import kept

AMBIGUOUS_SHARE = 0.2
TOP = 5
#: Looked-up words, or rows of a lexicon, that are broadcast at most. Beyond that only words with more than one row in FREQUENT are:
#: fewer than FREQUENT.
BROADCAST_ROWS = 20_000
FREQUENT = 1_000


def _kept(df: DataFrame) -> DataFrame:
    return kept(df, "lexicon")


def _shuffled(lookups: DataFrame) -> DataFrame:
    """A table with a row per word, to be joined by shuffle: its Parquet files are small enough for Spark to broadcast it by
    itself when its rows, unpacked and with their candidates, no longer fit in the driver."""
    return lookups.hint("merge")


def phrase_word_pairs(phrases: DataFrame) -> DataFrame:
    """(rumi, jawi, source, ord) of phrases with as many words on both sides; others become one mismatch row.

    ``phrases`` has rumi, jawi, ord.
    """
    words = lambda c: F.filter(F.split(F.col(c), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    both = phrases.select("ord", words("rumi").alias("r"), words("jawi").alias("j"))
    zipped = F.when(F.size("r") == F.size("j"), F.arrays_zip("r", "j")).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("r"), F.lit(None).cast("string").alias("j"))))
    rows = both.select("ord", (F.size("r") == F.size("j")).alias("aligned"), F.posexplode(zipped).alias("at", "p"))
    return rows.select(F.col("p.r").alias("rumi"), F.col("p.j").alias("jawi"), F.lit("phrase").alias("source"), "aligned", F.struct("ord", "at").alias("ord"))


def judged_pairs(word_pairs: DataFrame, phrases: DataFrame | None = None, script: Script = JAWI, composed: bool = False) -> DataFrame:
    """(reason, rumi, jawi, source, ord) of every pair; ``word_pairs`` has pair (array) and ord."""
    pair = F.col("pair")
    rows = word_pairs.select(
        F.get(pair, F.lit(0)).alias("rumi"), F.get(pair, F.lit(1)).alias("jawi"), F.lit("word").alias("source"), (F.size(pair) == 2).alias("aligned"), F.struct(F.col("ord").cast("long").alias("ord"), F.lit(0).alias("at")).alias("ord")
    )
    if phrases is not None:
        rows = rows.unionByName(phrase_word_pairs(phrases.withColumn("ord", F.col("ord").cast("long"))))
    judged = rows.withColumn("p", clean_pair(F.col("rumi"), F.col("jawi"), script, composed))
    unaligned = F.when(F.col("source") == "word", "malformed_row").otherwise("phrase_token_count_mismatch")
    named = F.when(F.col("source") == "word", F.col("p.reason")).otherwise(F.concat(F.lit("phrase_"), F.col("p.reason")))
    return judged.select(F.when(~F.col("aligned"), unaligned).otherwise(named).alias("reason"), F.col("p.rumi").alias("rumi"), F.col("p.jawi").alias("jawi"), "source", "ord")


def build_lexicon(judged: DataFrame) -> DataFrame:
    """(jawi, rumi, n, ord): how often each spelling reads as each word; ord ranks a spelling's words by count, first seen first."""
    rank = F.struct((F.col("source") != "word").alias("late"), "ord")
    counts = judged.filter("reason is null").groupBy("jawi", "rumi").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
    w = Window.partitionBy("jawi").orderBy(F.desc("n"), "first")
    return counts.select("jawi", "rumi", "n", F.row_number().over(w).alias("ord"))


def reject_report(judged: DataFrame) -> DataFrame:
    return judged.filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(judged: DataFrame) -> DataFrame:
    """(source, read, aligned, kept) of judged pairs: rows read, rows with both sides, and rows without a reject reason."""
    unaligned = F.col("reason").isin("malformed_row", "phrase_token_count_mismatch")
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("read"), F.count_if(~F.coalesce(unaligned, F.lit(False))).alias("aligned"), F.count_if(F.col("reason").isNull()).alias("kept"))


def _ambiguous(counts: Column) -> Column:
    """The runner-up's share of all counts, from counts in falling order."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(counts) > 1, F.get(counts, F.lit(1)) / total >= AMBIGUOUS_SHARE).otherwise(False)


def lexicon_report(lexicon: DataFrame) -> DataFrame:
    """entries, ambiguous entries."""
    per = lexicon.groupBy("jawi").agg(F.reverse(F.array_sort(F.collect_list("n"))).alias("counts"))
    return per.agg(F.count(F.lit(1)).alias("entries"), F.count_if(_ambiguous(F.col("counts"))).alias("ambiguous_entries"))


def skeleton_index(lexicon: DataFrame, script: Script = JAWI) -> DataFrame:
    """(skeleton, rumi, n, first): counts pooled over spellings of one skeleton."""
    keyed = lexicon.withColumn("skeleton", consonant_skeleton(F.col("jawi"), script))
    return keyed.groupBy("skeleton", "rumi").agg(F.sum("n").alias("n"), F.min(F.struct("jawi", "ord")).alias("first"))


def _ranked(pooled: DataFrame, key: str) -> DataFrame:
    """Per key: candidates by count, earliest first among equals; the rule of the winner; ambiguity over all of them."""
    one = F.struct((-F.col("n")).alias("m"), "first", "rumi", "rule")
    every = pooled.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("c"))
    return every.select(
        key,
        F.col("c")[0]["rumi"].alias("rumi"),
        F.col("c")[0]["rule"].alias("rule"),
        F.when(_ambiguous(F.transform("c", lambda x: -x["m"])), "ambiguous").otherwise("known").alias("status"),
        F.transform(F.slice("c", 1, TOP), lambda x: F.struct(x["rumi"].alias("rumi"), (-x["m"]).alias("n"))).alias("candidates"),
    )


def resolve_variants(keys: DataFrame, lexicon: DataFrame, script: Script = JAWI) -> DataFrame:
    """(key, rumi, rule, status, candidates) of the keys that the lexicon has in some spelling."""
    tried = keys.select("key", F.posexplode(spelling_variants(F.col("key"), script)).alias("at", "v")).select("key", "at", "v.variant", "v.rule")
    found = tried.join(lexicon, tried["variant"] == lexicon["jawi"])
    place = F.struct("at", "ord")
    pooled = found.groupBy("key", lexicon["rumi"]).agg(F.sum("n").alias("n"), F.min(place).alias("first"), F.min_by("rule", place).alias("rule"))
    return _ranked(pooled, "key")


def resolve_words(words: DataFrame, lexicon: DataFrame, script: Script = JAWI) -> DataFrame:
    """(word, rumi, status, rule, candidates) of every distinct word of ``words``.

    In this order: fixed clitics, spelling variants, a joined prefix with the rest looked up, the consonant skeleton
    (always ambiguous), and for hyphenated words their parts, which must all resolve.
    """
    words, lexicon = _kept(words.select("word").distinct()), _kept(lexicon)
    # a large lexicon meets the words in shuffles; it has no fewer rows than skeletons
    met = _shuffled if lexicon.count() > BROADCAST_ROWS else lambda few: few
    parts = words.filter(F.contains("word", F.lit("-"))).select("word", F.posexplode(F.split("word", "-")).alias("at", "part"))
    keys = words.select(F.col("word").alias("key")).union(parts.select("part")).distinct()
    prefixes = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(p).alias("prefix"), F.lit(r).alias("reads")) for i, (p, r) in enumerate(script.prefixes)])
    cut = keys.select("key", F.explode(prefixes).alias("p")).filter(F.startswith(F.col("key"), F.col("p.prefix")))
    cut = cut.select("key", "p.rank", "p.reads", F.expr("substring(key, length(p.prefix) + 1)").alias("rest")).filter(F.length("rest") >= script.least_rest)

    direct = _kept(resolve_variants(keys.union(cut.select("rest")).distinct(), met(lexicon), script))
    split = cut.join(_shuffled(direct.withColumnRenamed("key", "rest")), "rest").groupBy("key").agg(
        F.min(F.struct("rank", F.concat_ws(" ", "reads", "rumi").alias("rumi"), "status", F.concat(F.lit("prefix_split+"), "rule").alias("rule"), "candidates")).alias("p")
    )
    bones = _ranked(skeleton_index(lexicon, script).withColumn("rule", F.lit("consonant_skeleton")), "skeleton").withColumn("status", F.lit("ambiguous"))
    keyed = keys.withColumn("skeleton", consonant_skeleton(F.col("key"), script))

    shape = lambda source: F.struct(F.col(f"{source}.rumi").alias("rumi"), F.col(f"{source}.status").alias("status"), F.col(f"{source}.rule").alias("rule"), F.col(f"{source}.candidates").alias("candidates"))
    none = F.array().cast("array<struct<rumi:string,n:bigint>>")
    clitic = None
    for letter, reads in script.clitics.items():
        hit = F.struct(F.lit(reads).alias("rumi"), F.lit("known").alias("status"), F.lit("clitic_override").alias("rule"), none.alias("candidates"))
        clitic = F.when(F.col("key") == letter, hit) if clitic is None else clitic.when(F.col("key") == letter, hit)
    unknown = F.struct(F.lit(None).cast("string").alias("rumi"), F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("rule"), none.alias("candidates"))
    held = (
        keyed.join(_shuffled(direct.select("key", F.struct("rumi", "status", "rule", "candidates").alias("d"))), "key", "left")
        .join(_shuffled(split), "key", "left")
        .join(met(bones.select("skeleton", F.struct("rumi", "status", "rule", "candidates").alias("b"))), "skeleton", "left")
    )
    picks = [F.when(F.col(s).isNotNull(), shape(s)) for s in ("d", "p", "b")]
    single = _kept(held.select("key", F.coalesce(*([clitic] if clitic is not None else []), *picks, unknown).alias("w")).select("key", "w.*"))

    halves = parts.join(_shuffled(single.withColumnRenamed("key", "part")), "part").groupBy("word").agg(
        F.bool_and(F.col("rumi").isNotNull()).alias("whole"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "rumi"))), lambda x: x["rumi"]), "-").alias("joined"), F.bool_or(F.col("status") == "ambiguous").alias("doubt")
    )
    out = words.join(_shuffled(single.withColumnRenamed("key", "word")), "word").join(_shuffled(halves.filter("whole")), "word", "left")
    use = (F.col("status") == "unknown") & F.col("whole")
    found = out.select(
        "word",
        F.when(use, F.col("joined")).otherwise(F.col("rumi")).alias("rumi"),
        F.when(use, F.when(F.col("doubt"), "ambiguous").otherwise("known")).otherwise(F.col("status")).alias("status"),
        F.when(use, "hyphen_split").otherwise(F.col("rule")).alias("rule"),
        "candidates",
    )
    return _kept(found)


def document_tokens(docs: DataFrame, script: Script = JAWI, composed: bool = False) -> DataFrame:
    """(doc_id, at, text, is_word, reduplicated); ``docs`` has doc_id, text."""
    rows = docs.select("doc_id", F.posexplode(tokens(normalise_script(F.col("text"), script, composed), script)).alias("at", "t"))
    return rows.select("doc_id", "at", "t.text", "t.is_word", "t.reduplicated")


def _words_with_separators(docs: DataFrame, script: Script, composed: bool) -> DataFrame:
    """(doc_id, at, word, reduplicated, separator): the tokens of each document, a word and what stands behind it in one row. What
    stands behind no word is a row without one."""

    def rows(found: Column) -> Column:
        beside = lambda i: F.coalesce(F.get(found, i)["is_word"], F.lit(False))
        behind = lambda i: F.when(~beside(i + 1), F.get(found, i + 1)["text"])
        one = lambda t, i: F.struct(i.alias("at"), F.when(t["is_word"], t["text"]).alias("word"), t["reduplicated"].alias("reduplicated"), F.when(t["is_word"], behind(i)).otherwise(t["text"]).alias("separator"))
        return F.filter(F.transform(found, one), lambda r: r["word"].isNotNull() | ~beside(r["at"] - 1))

    return docs.select("doc_id", F.explode(once(tokens(normalise_script(F.col("text"), script, composed), script), rows)).alias("t")).select("doc_id", "t.*")


def word_counts(docs: DataFrame, script: Script = JAWI, composed: bool = False) -> DataFrame:
    """(doc_id, word, n): the distinct words of each document with their counts. They are those of ``document_tokens``, found without
    what stands between them."""
    words = F.regexp_extract_all(normalise_script(F.col("text"), script, composed), F.lit(f"({script.word})(?:{script.repeat_mark})?"), F.lit(1))
    return docs.select("doc_id", F.explode(words).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


def _attached(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """``rows`` (word, more) with their lookup. Up to BROADCAST_ROWS lookups are broadcast. Beyond that those of frequent words are,
    which are few by their definition, so that no task gets all rows of one word; the others meet in a shuffle."""
    if resolved.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(resolved), "word", "left")
    per = _kept(rows.groupBy("word").agg(F.count(F.lit(1)).alias("rows")))
    total = per.agg(F.sum("rows")).head()[0] or 0
    frequent = F.broadcast(per.filter(F.col("rows") * FREQUENT > total).select("word"))
    common = rows.join(F.broadcast(resolved.join(frequent, "word", "left_semi")), "word")
    rare = rows.join(frequent, "word", "left_anti").join(_shuffled(resolved), "word", "left")
    return common.unionByName(rare)


def looked_up(counted: DataFrame, lexicon: DataFrame, script: Script = JAWI) -> DataFrame:
    """(word, n) with the lookup of each word."""
    counted = _kept(counted)
    return _attached(counted, resolve_words(counted, lexicon, script))


def document_coverage(docs: DataFrame, lexicon: DataFrame, script: Script = JAWI, composed: bool = False) -> DataFrame:
    """Per document: doc_id, word_count, coverage, unknown_count, ambiguous_count and cases (both together). Words are counted
    before they are looked up."""
    counted = _kept(word_counts(docs, script, composed))
    met = _attached(counted, resolve_words(counted, lexicon, script).select("word", "status"))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    per = met.groupBy("doc_id").agg(F.sum("n").alias("word_count"), total(F.col("status") == "unknown").alias("unknown_count"), total(F.col("status") == "ambiguous").alias("ambiguous_count"))
    out = docs.select("doc_id").join(per, "doc_id", "left").fillna(0, ["word_count", "unknown_count", "ambiguous_count"])
    n = F.col("word_count")
    return out.select("doc_id", "word_count", F.when(n > 0, F.try_divide(n - F.col("unknown_count"), n)).otherwise(0.0).alias("coverage"), "unknown_count", "ambiguous_count", (F.col("unknown_count") + F.col("ambiguous_count")).alias("cases"))


def romanise(docs: DataFrame, lexicon: DataFrame, script: Script = JAWI, composed: bool = False) -> DataFrame:
    """Per document: doc_id, romanised text, word_count, coverage, unknown and ambiguous counts, case log."""
    placed = kept(_words_with_separators(docs, script, composed), "lexicon", compression="zstd")
    held = placed.filter("word is not null")
    words = _attached(held, resolve_words(held, lexicon, script))
    joined = words.unionByName(placed.filter("word is null"), allowMissingColumns=True)
    read = F.when(F.col("word").isNull(), "").when(F.col("rumi").isNull(), F.concat(F.lit("⟦"), "word", F.lit("⟧"))).when(F.col("reduplicated"), F.concat_ws("-", "rumi", "rumi")).otherwise(F.col("rumi"))
    shown = F.concat(read, F.coalesce(normalise_separator(F.col("separator"), script), F.lit("")))
    case = F.when(F.col("word").isNotNull() & (F.col("status") != "known"), F.struct("at", F.col("word").alias("jawi"), "rumi", "status", "rule", "candidates"))
    per = joined.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("at", shown.alias("s")))).alias("parts"),
        F.count("word").alias("word_count"),
        F.count_if(F.col("status") == "unknown").alias("unknown_count"),
        F.count_if(F.col("status") == "ambiguous").alias("ambiguous_count"),
        F.array_sort(F.collect_list(case)).alias("case_log"),
    )
    out = docs.select("doc_id").join(per, "doc_id", "left")
    n = F.coalesce("word_count", F.lit(0))
    return out.select(
        "doc_id",
        F.coalesce(F.array_join(F.transform("parts", lambda p: p["s"]), ""), F.lit("")).alias("text"),
        n.alias("word_count"),
        F.when(n > 0, 1 - F.col("unknown_count") / n).otherwise(0.0).alias("coverage"),
        F.coalesce("unknown_count", F.lit(0)).alias("unknown_count"),
        F.coalesce("ambiguous_count", F.lit(0)).alias("ambiguous_count"),
        "case_log",
    )


def coverage_report(words: DataFrame) -> DataFrame:
    """(kind, name, n) over word occurrences: totals by status, by rule, and all words. ``words`` has status, rule and n, how
    often the word occurs."""
    sets = words.groupingSets([["status"], ["rule"], []], "status", "rule").agg(F.sum("n").alias("n"), F.grouping("status").alias("gs"), F.grouping("rule").alias("gr"))
    kind = F.when(F.col("gs") == 0, "status").when(F.col("gr") == 0, "rule").otherwise("all")
    return sets.select(kind.alias("kind"), F.coalesce(F.when(F.col("gs") == 0, F.col("status")).when(F.col("gr") == 0, F.coalesce("rule", F.lit("none"))), F.lit("words")).alias("name"), "n")
