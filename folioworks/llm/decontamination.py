"""Benchmark decontamination by winnowing, in built-in DataFrame functions only.

A window is ``window`` consecutive words of an item. Every run of ``window`` words gives up its smallest k-gram hash, on
the training and on the test side, so two texts that share such a run share a fingerprint at the same place in it.
Fingerprints are joined, each hit fixes how item and document line up, and along that line the words themselves are
compared as far as a window that holds the fingerprint may reach; only agreeing runs of a whole window count, and runs that
overlap make one. An item of fewer words than a window is one window; its fingerprint is the hash of all its words.

A fingerprint's surroundings (context) in the benchmark are kept once, however often and in however many items they occur, so
a text and an item that both repeat one word meet in rows linear in the text. Each place of a document is a row of its own;
nothing is gathered per document but its runs and items.

Defined results: null or wordless texts have 0 words and no hits; wordless items are never hit; rows that share an id are
judged each on their own text; repeated items count once per item id; very long texts are compared whole; an empty benchmark
leaves every document clean, and an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A fingerprint is one long: the upper bits of the hash over the place of its gram, so the smallest of a window is its leftmost smallest gram.
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1
#: Fingerprints of the test side up to which they are broadcast (16 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(hashes: Column, k: int) -> Column:
    """One marked hash per place: every run of k words."""
    n = F.size(hashes) - F.lit(k - 1)
    marked = lambda i: F.xxhash64(F.slice(hashes, i, F.lit(k))).bitwiseAND(F.lit(~PLACE)).bitwiseOR((i - 1).cast("long").bitwiseAND(F.lit(PLACE)))
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), marked)).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: Column, span: int) -> Column:
    """The smallest gram of every ``span`` consecutive ones, each kept once."""
    n = F.size(grams) - F.lit(span - 1)
    smallest = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_min(F.slice(grams, i, F.lit(span))))
    return F.when(n >= 1, F.array_distinct(smallest)).otherwise(F.array().cast("array<bigint>"))


def _hashed(df: DataFrame, keep: list[str], k: int) -> DataFrame:
    """``keep`` and words of ``df``, with the hashes of the words and of their k-grams."""
    hashed = df.select(*keep, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("_h"))
    return hashed.select(*keep, "words", "_h", _grams(F.col("_h"), k).alias("_g"))


def _with_context(marks: Column, before: int, length: int) -> Column:
    """(print, place, context) of each mark: ``length`` words from ``before`` words ahead of the place on, null outside the
    text. Marks keep places modulo PLACE + 1, so all places that a mark may stand for are tried."""
    spots = lambda m: F.sequence(m.bitwiseAND(F.lit(PLACE)), F.greatest(m.bitwiseAND(F.lit(PLACE)), F.size("words").cast("long")), F.lit(PLACE + 1).cast("long"))

    def around(place: Column) -> Column:
        first = place.cast("int") - F.lit(before)
        return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(first + i >= 0, F.get("words", first + i)))

    one = lambda m: F.transform(spots(m), lambda p: F.struct(F.shiftright(m, PLACE_BITS).alias("print"), p.alias("place"), around(p).alias("context")))
    return F.flatten(F.transform(marks, one))


def _marked(df: DataFrame, keep: list[str], window: int, k: int, short: list[int], every: bool = False) -> DataFrame:
    """(keep, need, print, place, context) of ``df`` (keep, words): the smallest gram of every window, or every gram, with the
    words that a window which holds it may reach; and, for the lengths of short items, every gram of that length."""
    reach, grams = window - k, _hashed(df, keep, k)
    marks = F.col("_g") if every else _minima(F.col("_g"), reach + 1)
    found = [F.struct(F.lit(window).alias("need"), _with_context(marks, reach, window + reach).alias("marks"))]
    found += [F.struct(F.lit(n).alias("need"), _with_context(_grams(F.col("_h"), n), 0, n).alias("marks")) for n in short]
    rows = grams.select(*keep, F.explode(F.array(*found)).alias("f")).select(*keep, "f.need", F.explode("f.marks").alias("m"))
    return rows.select(*keep, "need", "m.print", "m.place", "m.context")


def _contexts(items: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """(print, need, context, item_id): the words around each fingerprint of each item. All places of a gram that is the
    smallest of some window count, so which of equal grams a text keeps makes no difference."""
    long = items.filter(F.size("words") >= window)
    prints = _hashed(long, ["item_id"], k).select("item_id", F.explode(_minima(F.col("_g"), window - k + 1)).alias("m")).select("item_id", F.shiftright("m", PLACE_BITS).alias("print")).distinct()
    found = _marked(long, ["item_id"], window, k, [], every=True).join(prints, ["item_id", "print"], "left_semi").select("print", "need", "context", "item_id")
    for n in short:
        whole = _marked(items.filter(F.size("words") == n), ["item_id"], window, k, [n]).filter(F.col("need") == n)
        found = found.unionByName(whole.select("print", "need", "context", "item_id"))
    return found.distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted ids as strings), contaminated, and hit_spans, the
    runs of hit words as (start, end) in words."""
    test = items.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("words")).filter(F.size("words") > 0).distinct()
    short = sorted(r[0] for r in test.select(F.size("words").alias("n")).filter(F.col("n") < window).distinct().collect())  # at most window - 1 numbers
    known = materialise(_contexts(test, window, k, short), "contexts")
    # items that share a context, and places of an item with one context, are compared once
    contexts = known.select("print", "need", "context", F.xxhash64("print", "need", "context").alias("ctx")).distinct()
    prints = known.select("print", "need").distinct()
    n_prints = known.count()

    def held(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if n_prints <= BROADCAST_ROWS else small

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    split = rows.select("doc_id", "_key", F.explode(F.array(words_of(F.col("_text")))).alias("words"))  # a generator, so that nothing repeats the split
    hashed = split.select("doc_id", "_key", F.size("words").cast("long").alias("n_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("_h"))
    distinct = lambda g: F.array_distinct(F.transform(g, lambda m: F.shiftright(m, PLACE_BITS)))
    marks = [F.struct(F.lit(window).alias("need"), distinct(_minima(F.col("_g"), window - k + 1)).alias("prints"))]
    marks += [F.struct(F.lit(n).alias("need"), distinct(_grams(F.col("_h"), n)).alias("prints")) for n in short]
    base = materialise(hashed.select("doc_id", "_key", "n_words", "_h", _grams(F.col("_h"), k).alias("_g")).select("doc_id", "_key", "n_words", F.array(*marks).alias("marks")), "prints")

    met = base.select("doc_id", "_key", F.explode("marks").alias("m")).select("doc_id", "_key", "m.need", F.explode("m.prints").alias("print")).join(held(prints), ["print", "need"], "left_semi")
    texts = rows.join(met.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k")).distinct(), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left_semi")
    texts = materialise(texts.select("doc_id", "_key", words_of(F.col("_text")).alias("words")).dropDuplicates(["doc_id", "_key"]), "candidates")

    reach = window - k
    at = _marked(texts, ["doc_id", "_key"], window, k, short).withColumnRenamed("context", "mine")
    agree = F.array_join(F.zip_with("mine", "context", lambda a, b: F.when(a == b, "1").otherwise("0")), "")
    full = F.repeat(F.lit("1"), F.col("need"))
    offsets = F.filter(F.sequence(F.lit(0), F.size("context") - F.col("need")), lambda i: F.substring("agree", i + 1, F.col("need")) == full)
    extended = at.join(held(contexts), ["print", "need"]).withColumn("agree", agree)
    ahead = F.when(F.col("need") == window, F.lit(reach)).otherwise(F.lit(0))
    windows = extended.select("doc_id", "_key", "ctx", "need", (F.col("place") - ahead).alias("first"), F.explode(offsets).alias("i"))
    windows = materialise(windows.select("doc_id", "_key", "ctx", (F.col("first") + F.col("i")).alias("start"), "need").distinct(), "windows")

    spans = _runs(windows.select("doc_id", "_key", "start", (F.col("start") + F.col("need")).alias("end")).distinct())
    owners = known.select(F.xxhash64("print", "need", "context").alias("ctx"), F.col("item_id").cast("string").alias("item")).distinct()
    named = windows.select("doc_id", "_key", "ctx").distinct().join(owners, "ctx").groupBy("doc_id", "_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = spans.join(named.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "items"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")))
    hits = hits.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "n_hit", "items", "hit_spans")
    out = base.select("doc_id", "_key", "n_words").join(hits, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        F.coalesce("hit_spans", none).alias("hit_spans"),
    )


def _runs(spans: DataFrame) -> DataFrame:
    """(doc_id, _key, n_hit, hit_spans): overlapping and touching spans as runs, and the places they cover."""
    order = Window.partitionBy("doc_id", "_key").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh_run = F.coalesce(F.col("start") > F.col("before"), F.lit(True)).cast("int")
    marked = spans.withColumn("before", before).withColumn("run", F.sum(fresh_run).over(order))
    runs = marked.groupBy("doc_id", "_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id", "_key").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hit_spans"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), g AS (
  SELECT item_id, least(10, len(w)) AS k, w, unnest(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))) AS s FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS words FROM g
), sizes AS (SELECT DISTINCT k FROM windows), places AS (
  SELECT doc_id, k, w, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS s FROM d, sizes WHERE len(w) >= k
), hits AS (
  SELECT p.doc_id, p.s, p.k, x.item_id FROM places p JOIN windows x ON x.k = p.k AND x.words = array_to_string(list_slice(p.w, p.s, p.s + p.k - 1), ' ')
), covered AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS spot FROM hits) AS spots GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) AS ids GROUP BY doc_id
)
SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
