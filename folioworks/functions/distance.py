"""Edit distances, agreement and the helpers that Spark has no built-in for."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from . import bitvectors
from .text import collapse, normalise_for_comparison, once

GATE = 0.85


#: A pair whose distance is no more than this is settled by a table of so many diagonals; bit vectors are quicker than a wider one.
NEAR = 12


@pandas_udf(StructType().add("edits", LongType()).add("a_chars", LongType()).add("b_chars", LongType()))
def _settled(pairs: pd.DataFrame) -> pd.DataFrame:
    """``near`` where it is a distance; else that of the texts, which only those rows have."""
    out = pairs[["near", "a_chars", "b_chars"]].astype("Int64").rename(columns={"near": "edits"})
    far = (out["edits"] < 0).fillna(False)
    out.loc[far, "edits"] = [bitvectors.distance(x, y) for x, y in zip(pairs["a"][far], pairs["b"][far])]
    return out


def measured(a: Column, b: Column) -> Column:
    """struct<edits, a_chars, b_chars> of two texts, null edits if one is null. Exact at every length: pairs that are near to each
    other take a bounded distance within the JVM, in time in proportion to their length; only texts farther apart are handed on to
    bit vectors."""
    far = lambda s, c: F.when(s["near"] < 0, s[c]).alias(c)
    near = once(F.struct(a.alias("a"), b.alias("b")), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.levenshtein(s["a"], s["b"], NEAR).alias("near")))
    return _settled(once(near, lambda s: F.struct(s["near"].alias("near"), F.length(s["a"]).alias("a_chars"), F.length(s["b"]).alias("b_chars"), far(s, "a"), far(s, "b"))))


def compute_cer(ref: Column, hyp: Column) -> Column:
    """Character error rate of one pair over collapsed texts; an empty reference gives 0 or 1."""
    pair = measured(collapse(F.coalesce(ref, F.lit(""))), collapse(F.coalesce(hyp, F.lit(""))))
    return once(pair, lambda m: F.when(m["a_chars"] == 0, F.when(m["b_chars"] == 0, 0.0).otherwise(1.0)).otherwise(F.round(m["edits"] / m["a_chars"], 4)))


def character_agreement(a: Column, b: Column, composed: bool = False) -> Column:
    """1 - distance over the longer text; 0 when both are empty."""
    longest = lambda m: F.greatest(m["a_chars"], m["b_chars"])
    share = lambda m: F.when(longest(m) == 0, 0.0).otherwise(1 - m["edits"] / longest(m))
    return once(measured(normalise_for_comparison(a, composed), normalise_for_comparison(b, composed)), share)


def percent(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", 100 * x)


def agreement_gate(a: Column, b: Column, coverage: Column | None = None, threshold: float = GATE, composed: bool = False) -> Column:
    """struct<agreement, threshold, passed, method_b_coverage, status, reason>; the rounded agreement meets the threshold."""
    coverage = F.lit(None).cast("double") if coverage is None else coverage
    return once(F.round(character_agreement(a, b, composed), 4), lambda agreement: _verdict(agreement, coverage, threshold))


def _verdict(agreement: Column, coverage: Column, threshold: float) -> Column:
    passed = agreement >= threshold
    limit = f" (threshold {threshold:.0%})"
    low = F.when(coverage < threshold, F.concat(F.lit(" Method B dictionary covered "), percent(coverage, 1), F.lit(" of words, which may explain part of the gap."))).otherwise("")
    reason = F.when(passed, F.concat(F.lit("Methods A and B agree at "), percent(agreement, 1), F.lit(limit + "."))).otherwise(
        F.concat(F.lit("Methods A and B agree at only "), percent(agreement, 1), F.lit(limit + "; flagged for human review."), low)
    )
    return F.struct(
        agreement.alias("agreement"), F.lit(threshold).alias("threshold"), passed.alias("passed"), F.round(coverage, 4).alias("method_b_coverage"), F.when(passed, "passed").otherwise("flagged").alias("status"), reason.alias("reason")
    )


GRAM_HITS = "array<struct<n:int,hit:bigint,hyp:bigint,ref:bigint>>"


def gram_counts(hyp: Column, ref: Column, orders: int) -> Column:
    """Per order n: how many n-grams of ``hyp`` and ``ref`` there are, and how many of ``hyp`` hit, each at most as often as
    ``ref`` has it. Both are texts (grams of characters) or arrays of tokens; nulls have none."""

    def grams(x, n: int) -> Counter:
        return Counter(x[i : i + n] for i in range(len(x) - n + 1))

    @pandas_udf(GRAM_HITS)
    def count(hyps: pd.Series, refs: pd.Series) -> pd.Series:
        out = []
        for h, r in zip(hyps, refs):
            h, r = (() if x is None else x if isinstance(x, str) else tuple(x) for x in (h, r))
            rows = []
            for n in range(1, orders + 1):
                a, b = grams(h, n), grams(r, n)
                hit = sum(min(k, b[g]) for g, k in a.items() if g in b)
                rows.append({"n": n, "hit": hit, "hyp": max(0, len(h) - n + 1), "ref": max(0, len(r) - n + 1)})
            out.append(rows)
        return pd.Series(out)

    return count(hyp, ref)


@pandas_udf(LongType())
def lcs_chars(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bitvectors.common_subsequence(x or "", y or "") for x, y in zip(a, b)])


@pandas_udf(LongType())
def lcs_words(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bitvectors.common_subsequence(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b)])


def similarity_ratio(a: Column, b: Column) -> Column:
    """Insert and delete similarity of two texts in percent, 2 digits; 0 if either is empty."""
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.round(200.0 * lcs_chars(a, b) / (F.length(a) + F.length(b)), 2)).otherwise(0.0)


@pandas_udf(ArrayType(StringType()))
def source_errors(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([bitvectors.source_errors(r or "", h or "") for r, h in zip(ref, hyp)])
