"""User callables on distributed rows: line romanisers, page recognisers and text stages, with status columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

PAGE_LINE = "document string, page int, ord int, text string, confidence double"


def romanise_lines(texts: DataFrame, romanise: Callable[[list[str]], list[str]], key: str = "doc_id", text: str = "text", batch: int = 16) -> DataFrame:
    """Texts with ``romanised``: the callable gets non-blank lines in batches, blank lines stay where they are."""
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "line"))
    filled, blank = lines.filter(strip(F.col("line")) != ""), lines.filter(strip(F.col("line")) == "")
    kind = dict(texts.dtypes)[key]

    def run(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in parts:
            out: list[str] = []
            for i in range(0, len(pdf), batch):
                out += romanise(pdf["line"].iloc[i : i + batch].tolist())
            yield pdf.assign(line=out)

    done = filled.mapInPandas(run, f"{key} {kind}, at int, line string").unionByName(blank)
    return done.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("romanised"))


def recognise_pages(pages: DataFrame, recognise: Callable[[bytes], list[tuple[str, float | None]]]) -> DataFrame:
    """Line rows of page images: ``pages`` has document, page, content; the callable gives (text, confidence) per line."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in parts:
            rows = [(d, p, i, t, c) for d, p, content in zip(pdf["document"], pdf["page"], pdf["content"]) for i, (t, c) in enumerate(recognise(content), 1)]
            yield pd.DataFrame(rows, columns=["document", "page", "ord", "text", "confidence"])

    return pages.select("document", "page", "content").mapInPandas(run, PAGE_LINE)


def text_stage(texts: DataFrame, stage: Callable[[str], str], name: str, key: str = "doc_id", text: str = "text", attempts: int = 1) -> DataFrame:
    """(key, stage, output, status, error, attempts): errors and empty outputs become a status; others are not hurt. A null text is an empty one."""
    kind = dict(texts.dtypes)[key]

    def one(value: str) -> tuple:
        error = None
        for n in range(1, attempts + 1):
            try:
                out = stage(value)
            except TimeoutError as e:
                error = ("failed_timeout", str(e))
            except Exception as e:  # noqa: BLE001  whatever user code raises is this row's outcome
                error = ("failed_exception", str(e))
            else:
                return (out, "completed", None, n) if out and out.strip() else (out, "failed_empty_output", None, n)
        return (None, *error, attempts)

    def run(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in parts:
            rows = [(k, name, *one(v)) for k, v in zip(pdf[key], pdf[text])]
            yield pd.DataFrame(rows, columns=[key, "stage", "output", "status", "error", "attempts"])

    return texts.select(key, F.coalesce(text, F.lit("")).alias(text)).mapInPandas(run, f"{key} {kind}, stage string, output string, status string, error string, attempts int")


def repaired(texts: DataFrame, first: DataFrame, valid, repair: Callable[[str], str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``first`` with one repair pass over the rows whose output is not valid; ``valid`` is a condition on the output."""
    wrong = first.filter(~F.coalesce(valid, F.lit(False))).select(key)
    again = text_stage(texts.join(wrong, key, "left_semi"), repair, "repair", key, text).select(key, F.col("output").alias("_o"), F.col("status").alias("_s"))
    both = first.join(again, key, "left").withColumn("repaired", F.col("_s").isNotNull())
    return both.withColumn("output", F.coalesce("_o", "output")).withColumn("status", F.coalesce("_s", "status")).drop("_o", "_s")


def stand_in(stage: str, text):
    """Deterministic columns in place of the callables, for tests and dry runs."""
    return {"romanise": F.lower(text), "translate": F.concat(F.lit("[en] "), text), "summarise": F.substring(text, 1, 80), "extract": F.to_json(F.struct(F.array(F.substring_index(text, " ", 1)).alias("people")))}[stage]
