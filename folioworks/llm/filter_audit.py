"""Interaction of corpus filters: what each removes alone, after the others, and on average over all orders.

Word statistics come from a sparse document-term matrix. ``term_shards`` encodes words in one dictionary of the whole table:
tasks turn their rows into CSR slices over a dictionary of their shard, the distinct words of the shards meet in one sort
that numbers them, and each shard gets the numbers of its own words back, so a word travels once per shard and not once per
place. ``document_checks`` reads word and distinct-word counts off the CSR rows; ``interactions`` adds up the orders.

Filters, by letter, with what a row must meet to fail: A fewer than ``min_words`` words; B distinct words below
``min_distinct`` percent of the words; C capital letters A-Z above ``max_capitals`` percent of the code points; D any of
``SYMBOLS``; E its text is that of a row with a smaller id.

Defined results: a null text counts as empty, so all null and empty texts are equal; a row with a null id never fails E and
makes no other row fail it; rows that repeat an id count one by one and, their ids being equal, do not fail E through each
other; a null part is the empty string; a row without a label is neither good nor toxic, one with several labels is what any
of them says. A text is held whole by one task, whatever its length, in memory in proportion to it. Further columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import materialise

FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
#: Bytes of text of one CSR slice, and words and distinct words at which a shard ends. A text is never cut, so one longer than that is a slice.
SLICE_BYTES, SHARD_WORDS, SHARD_TERMS = 1 << 20, 4 << 20, 1 << 20
#: A text that more than one row in so many has is looked up in a broadcast table, which therefore has fewer rows than this.
COMMON_TEXT = 4096
#: A slice is a row of megabytes. A task that writes or reads slices holds a row group of them, so these are small and looked at after every row.
#: Words and terms of a shard are distinct or nearly, so no dictionary of them pays.
ROW_GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": False}
SALTS = 64

ROWS = "doc_id array<long>, part array<string>, digest array<binary>, capitals array<boolean>, symbols array<boolean>"
LOCAL = f"kind string, shard long, position int, words array<string>, {ROWS}, bounds array<int>, terms array<int>, counts array<int>"
SHARDS = f"shard long, {ROWS}, bounds array<int>, terms array<long>, counts array<int>"
CHECKS = "doc_id long, part string, digest binary, capitals boolean, symbols boolean, n_words long, n_distinct long"

_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_STARTS = (np.arange(256) & 0xC0) != 0x80


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    before = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=before[1:])
    return np.diff(before[bounds])


def _lists(values: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    """One list that holds all values."""
    held = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held.cast(kind))


def _local_rows(max_capitals: int):
    """Batches of (doc_id, part, text) to CSR slices over shard dictionaries, and those dictionaries' words."""
    arrow = [("kind", pa.string()), ("shard", pa.int64()), ("position", pa.int32()), ("words", pa.list_(pa.string()))]
    lists = [("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("capitals", pa.bool_()), ("symbols", pa.bool_()), ("bounds", pa.int32()), ("terms", pa.int32()), ("counts", pa.int32())]
    schema = pa.schema([*arrow, *((n, pa.list_(t)) for n, t in lists)])

    def run(batches):
        known: dict[str, int] = {}
        shard, held = TaskContext.get().partitionId() << 24, 0

        def dictionary():
            every = list(known)
            for at in range(0, len(every), 65_536):
                some = pa.array([every[at : at + 65_536]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(["words"]), pa.array([shard], pa.int64()), pa.array([at], pa.int32()), some, *(pa.nulls(1, pa.list_(t)) for _, t in lists)], schema=schema)

        for batch in batches:
            whole = batch.column(2).fill_null("").cast(pa.large_string())
            for at, n in words.slices(batch, whole, SLICE_BYTES):
                # A copy of the slice alone: its buffer begins at its first text.
                texts = pa.concat_arrays([whole.slice(at, n), pa.array([], pa.large_string())])
                bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
                data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
                bounds = bounds - bounds[0]
                capitals = 100 * _per_text(_CAPITAL[data], bounds) > max_capitals * _per_text(_STARTS[data], bounds)
                symbols = _per_text(_SYMBOL[data], bounds) > 0
                raw = data.tobytes()
                digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                values, length = words.split(texts)
                coded = values.dictionary_encode()
                here = coded.dictionary.to_pylist()
                if held and (held + len(values) > SHARD_WORDS or len(known) + len(here) > SHARD_TERMS):
                    yield from dictionary()
                    known, shard, held = {}, shard + 1, 0
                held += len(values)
                number = np.fromiter((known.setdefault(w, len(known)) for w in here), dtype=np.int64, count=len(here))
                row = np.repeat(np.arange(n), length)
                cells, counts = np.unique(row << 32 | number[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
                ends = np.searchsorted(cells, np.arange(n + 1) << 32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["rows"]), pa.array([shard], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.string()))]
                    + [_lists(v, t) for v, (_, t) in zip((batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(digests, pa.binary()), capitals, symbols, ends, cells & 0xFFFFFFFF, counts), lists)],
                    schema=schema,
                )
        yield from dictionary()

    return run


def _numbered(batches):
    """Numbers the distinct words of a sorted partition; its number in the upper bits keeps words of different partitions apart."""
    number, before = (TaskContext.get().partitionId() << 33) - 1, None
    for batch in batches:
        word = batch.column(2)
        if not len(word):
            continue
        fresh = np.ones(len(word), dtype=np.int64)
        fresh[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
        fresh[0] = word[0].as_py() != before
        numbers = number + np.cumsum(fresh)
        number, before = int(numbers[-1]), word[-1].as_py()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.int64())], ["of_shard", "position", "number"])


def term_shards(docs: DataFrame, max_capitals: int = 2, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text", use: Callable[[pa.Table], pa.Table] | None = None, schema: str = SHARDS) -> DataFrame:
    """CSR slices of the document-term matrix. A row holds some documents: their ids, parts, digests and checks, and for the
    i-th of them its term numbers and counts at places ``bounds[i]`` up to ``bounds[i + 1]``. Terms are numbered alike in all rows.
    With ``use``, what that makes of a shard's rows, in ``schema``, where they are: they need not leave their task."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    local = materialise(rows.mapInArrow(_local_rows(max_capitals), LOCAL), "term-slices", **ROW_GROUPS)
    held = local.filter("kind = 'words'").select("shard", "position", F.posexplode("words").alias("at", "word")).select("shard", (F.col("position") + F.col("at")).alias("position"), "word")
    # A word is held once by a shard, so no word has more rows than there are shards. Those of one word stand together.
    numbered = held.repartition("word").sortWithinPartitions("word").mapInArrow(_numbered, "of_shard long, position int, number long")
    slices = local.filter("kind = 'rows'").select("shard", "doc_id", "part", "digest", "capitals", "symbols", "bounds", "terms", "counts")

    def renumber(left: pa.Table, right: pa.Table) -> pa.Table:
        number = np.empty(right.num_rows, dtype=np.int64)
        number[right["position"].to_numpy()] = right["number"].to_numpy()
        terms = left["terms"].combine_chunks()
        flat = pa.array(number[terms.flatten().to_numpy(zero_copy_only=False)], pa.int64())
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))])
        found = left.set_column(left.column_names.index("terms"), "terms", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
        return use(found) if use else found

    return slices.groupBy("shard").cogroup(numbered.groupBy("of_shard")).applyInArrow(renumber, schema)


def _row_sums(shard: pa.Table) -> pa.Table:
    found = []
    for batch in shard.to_batches():
        for at in range(batch.num_rows):
            one = {n: batch.column(n)[at].values for n in batch.schema.names if n != "shard"}
            bounds = one["bounds"].to_numpy()
            before = np.concatenate([[0], np.cumsum(one["counts"].to_numpy().astype(np.int64))])
            found.append(
                pa.table(
                    [*(one[n] for n in ("doc_id", "part", "digest", "capitals", "symbols")), pa.array(np.diff(before[bounds]), pa.int64()), pa.array(np.diff(bounds), pa.int64())],
                    ["doc_id", "part", "digest", "capitals", "symbols", "n_words", "n_distinct"],
                )
            )
    return pa.concat_tables(found)


def document_checks(docs: DataFrame, min_words: int = 200, min_distinct: int = 50, max_capitals: int = 2, **columns: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, part, n_words, n_distinct and ``fails``, the letters of the filters it fails alone."""
    rows = materialise(term_shards(docs, max_capitals, **columns, use=_row_sums, schema=CHECKS), "document-checks")
    copies = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1").select("digest", "n", "first")
    copies = materialise(copies, "equal-texts")
    limit = rows.count() / COMMON_TEXT
    common, other = (copies.filter(c).select("digest", "first") for c in (F.col("n") > limit, F.col("n") <= limit))
    # Every row meets the common texts without a shuffle; the rest has no digest with many rows.
    marked = rows.join(F.broadcast(common.select("digest", F.col("first").alias("common_first"), F.lit(True).alias("is_common"))), "digest", "left")
    rare = marked.filter("is_common is null").join(other, "digest", "left")
    both = rare.unionByName(marked.filter("is_common").withColumn("first", F.col("common_first")))
    failing = {
        "A": F.col("n_words") < min_words,
        "B": 100 * F.col("n_distinct") < min_distinct * F.col("n_words"),
        "C": F.col("capitals"),
        "D": F.col("symbols"),
        "E": F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)),
    }
    return both.select("doc_id", "part", "n_words", "n_distinct", F.concat(*(F.when(failing[f], f).otherwise("") for f in FILTERS)).alias("fails"))


def with_labels(checks: DataFrame, labels: DataFrame) -> DataFrame:
    """``checks`` with ``good`` and ``toxic``."""
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic")).withColumn("spread", F.lit(0))
    # Null ids meet no label; they are spread so that they do not gather in one task.
    keyed = checks.withColumn("spread", F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    return keyed.join(known, ["doc_id", "spread"], "left").select(
        F.when(F.col("spread") == 0, F.col("doc_id")).alias("doc_id"), "part", "n_words", "n_distinct", "fails", *(F.coalesce(f"is_{c}", F.lit(False)).alias(c) for c in ("good", "toxic"))
    )


def interactions(checks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts per part, order of the filters and step. Rows that fail the same filters are counted before orders are applied."""
    counted = materialise(checks.groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n")), "failing-rows")
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = counted.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    steps = steps.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    fails = F.expr("contains(fails, filter)")
    earlier = F.expr("translate(fails, substring(filter_order, 1, step - 1), '') <> fails")
    after = F.expr("translate(fails, substring(filter_order, 1, step), '') <> fails")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total(~after).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("fails") == F.col("filter")).alias("unique_fails"),
        total(fails & ~earlier & F.col("good")).alias("good_lost"),
        total(fails & ~earlier & F.col("toxic")).alias("toxic_lost"),
    )
    shares = out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(shares, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole texts, per source, in every order."""
    return interactions(with_labels(document_checks(docs), labels))


def oracle() -> str:
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), checked AS (
  SELECT t.doc_id, t.part, t.text, regexp_extract_all(t.text, '[^\x20\x09-\x0D]+') AS words, coalesce(f.first < t.doc_id, false) AS again
  FROM texts t JOIN firsts f USING (text)
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, good, toxic, count(*) AS n,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN again THEN 'E' ELSE '' END AS fails
  FROM checked LEFT JOIN known USING (doc_id) GROUP BY ALL
), orders(filter_order) AS (VALUES {orders}),
steps AS (
  SELECT *, substring(filter_order, step, 1) AS letter, translate(fails, substring(filter_order, 1, step - 1), '') <> fails AS earlier,
    translate(fails, substring(filter_order, 1, step), '') <> fails AS gone
  FROM counted, orders, (SELECT unnest(range(1, 6))::INT AS step)
), summed AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT gone THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, letter) AND NOT earlier THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, letter) AND earlier THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, letter) AND NOT earlier AND good = 1 THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, letter) AND NOT earlier AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM summed
"""
