"""Ratios, JSON checks, routing and status columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, strip

KNOWLEDGE_FIELDS = ("people", "places", "dates", "organizations", "themes", "key_claims")
#: Fixed sentences of the routing label.
SHORT_LABEL = "Short snippet (%d words) — skipping summary agent"
FULL_LABEL = "Full article (%d words) — running all 4 agents"
TERMINAL = ("completed", "needs_review", "failed")
GATE_STAGE_STATUS = {"passed": "completed", "flagged": "needs_review", "skipped": "skipped"}


def ratio(num: Column, den: Column) -> Column:
    """Null on an empty denominator, else 6 digits."""
    return F.when(den != 0, F.round(num / den, 6))


def safe_ratio(num: Column, den: Column) -> Column:
    """0 on an empty denominator."""
    return F.when(den != 0, num / den).otherwise(0.0)


def prf(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def token_confidence(logprobs: Column, ids: Column, end_id: int) -> Column:
    """exp of the mean log-probability up to and with the first end token, within 0 and 1, 4 digits."""
    stop = F.array_position(ids, end_id).cast("int")
    used = F.when(stop > 0, F.slice(logprobs, F.lit(1), F.greatest(stop, F.lit(1)))).otherwise(logprobs)
    mean = F.aggregate(used, F.lit(0.0), lambda acc, x: acc + x) / F.size(used)
    return F.when(F.size(used) > 0, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(mean))), 4)).otherwise(0.0)


def estimate_cost(model: Column, image_chars: Column, prompt_chars: Column, output_chars: Column, priced: str = "mini") -> Column:
    """Dollars by characters for the priced models, null for others."""
    tokens_in, tokens_out = image_chars / 750.0 + prompt_chars / 4.0, output_chars / 4.0
    return F.when(F.contains(model, F.lit(priced)), (tokens_in * 0.15 + tokens_out * 0.60) / 1e6)


def json_object_text(text: Column) -> Column:
    """From the first ``{`` to the last ``}`` of a model's answer, code fences gone; null if there is none."""
    bare = F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row. A column that is merely named several times is worked out as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def validate_knowledge(text: Column, fields: tuple = KNOWLEDGE_FIELDS) -> Column:
    """struct<valid, reason, fields>: every field must be a list of strings or one string; blanks go."""
    part = lambda value: F.struct(*[F.try_variant_get(value, f"$.{f}", "variant").alias(f) for f in fields])
    kind = lambda parts: F.struct(*[F.schema_of_variant(parts[f]).alias(f) for f in fields])
    checked = lambda raw, value, parts: bound(kind(parts), lambda kinds: bound(_reason(raw, value, kinds, fields), lambda reason: _knowledge(parts, kinds, reason, fields)))
    return bound(json_object_text(text), lambda raw: bound(F.try_parse_json(raw), lambda value: bound(part(value), lambda parts: checked(raw, value, parts))))


def _reason(raw: Column, value: Column, kinds: Column, fields: tuple) -> Column:
    present = F.coalesce(F.json_object_keys(F.when(value.isNotNull(), raw)), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*map(F.lit, fields)), present)
    wrong = F.array_compact(F.array(*[F.when(~kinds[f].isin("STRING", "ARRAY<STRING>", "ARRAY<VOID>"), f) for f in fields]))
    lacks = bound(missing, lambda m: F.when(F.size(m) > 0, F.concat(F.lit("missing keys: "), F.array_join(m, ", "))))
    other = bound(wrong, lambda w: F.when(F.size(w) > 0, F.concat(F.lit("not a list of strings: "), F.array_join(w, ", "))))
    return F.when(raw.isNull() | value.isNull() | ~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), "response is not a JSON object").otherwise(F.coalesce(lacks, other))


def _knowledge(parts: Column, kinds: Column, reason: Column, fields: tuple) -> Column:
    listed = {f: F.when(kinds[f] == "STRING", F.array(F.try_variant_get(parts[f], "$", "string"))).otherwise(F.try_variant_get(parts[f], "$", "array<string>")) for f in fields}
    clean = {f: F.filter(F.transform(F.coalesce(listed[f], F.array().cast("array<string>")), strip), lambda x: x != "") for f in fields}
    return F.struct(reason.isNull().alias("valid"), reason.alias("reason"), F.when(reason.isNull(), F.struct(*[clean[f].alias(f) for f in fields])).alias("fields"))


def message_text(response: Column) -> Column:
    """struct<text, error> of a chat answer: content is a string, or a list of strings and {text} parts."""
    return bound(F.try_parse_json(response), lambda value: bound(F.try_variant_get(value, "$.choices[0].message.content", "variant"), lambda content: bound(_content_text(content), lambda text: _message(value, text))))


def _content_text(content: Column) -> Column:
    kind = F.schema_of_variant(content)
    items = F.try_variant_get(content, "$", "array<variant>")
    joined = F.array_join(F.transform(items, lambda i: F.coalesce(F.try_variant_get(i, "$.text", "string"), F.when(F.schema_of_variant(i) == "STRING", F.try_variant_get(i, "$", "string")), F.lit(""))), "")
    return strip(F.when(kind == "STRING", F.try_variant_get(content, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), joined).otherwise(""))


def _message(value: Column, text: Column) -> Column:
    finish = F.try_variant_get(value, "$.choices[0].finish_reason", "string")
    none = F.try_variant_get(value, "$.choices[0]", "variant").isNull()
    error = F.when(none, "no_choices").when((F.coalesce(text, F.lit("")) == "") & (finish == "length"), "length_limit").when(F.coalesce(text, F.lit("")) == "", "empty")
    return bound(error, lambda e: F.struct(F.when(e.isNull(), text).alias("text"), e.alias("error")))


def is_empty(text: Column) -> Column:
    """Null or nothing but white space of any kind."""
    return text.isNull() | (strip(text) == "")


def is_empty_list(items: Column) -> Column:
    """The same for arrays and maps: null or without members."""
    return items.isNull() | (F.size(items) == 0)


def iso_seconds(ts: Column) -> Column:
    """A timestamp as ISO text with seconds and zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def elapsed(started: Column, finished: Column) -> Column:
    """Seconds from start to finish, 2 digits; null while one is missing."""
    return F.round((F.unix_micros(finished) - F.unix_micros(started)) / 1e6, 2)


def low_confidence(confidence: Column, threshold: Column | float) -> Column:
    """Null without a score, else whether it is below the threshold."""
    return F.when(confidence.isNotNull(), confidence < threshold)


def preview(text: Column, lines: int) -> Column:
    """The first lines of a text."""
    return F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, lines), "\n")


def fallback(*texts: Column) -> Column:
    """The first that is not blank."""
    return F.coalesce(*[F.when(~is_empty(t), t) for t in texts])


def route(text: Column, least_words: int = 10) -> Column:
    """struct<word_count, summarise, label>: short texts skip the summary."""
    clean = collapse(F.coalesce(text, F.lit("")))
    n = F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))
    label = F.when(n < least_words, F.format_string(SHORT_LABEL, n)).otherwise(F.format_string(FULL_LABEL, n))
    return F.struct(n.alias("word_count"), (n >= least_words).alias("summarise"), label.alias("label"))


def input_status(text: Column, pages: Column, size: Column, file_type: Column, most_chars: int, most_pages: int, most_bytes: int) -> Column:
    """The status an input is refused with, or null."""
    return (
        F.when(file_type.isNull(), 400).when(size > most_bytes, 413).when(pages > most_pages, 413).when(F.length(text) > most_chars, 413).when(is_empty(text), 400)
    ).cast("int")


def file_type(content: Column) -> Column:
    """pdf, png or jpg by the leading bytes, else null."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(F.startswith(head, F.lit("255044462D")), "pdf").when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png").when(F.startswith(head, F.lit("FFD8FF")), "jpg")
    )


def verified_evidence(evidence: Column, source: Column) -> Column:
    """The {entity, quote} pairs whose quote stands verbatim in the source, white space aside; none if the source is null."""
    hay = collapse(F.coalesce(source, F.lit("")))
    return F.filter(evidence, lambda e: (collapse(e["quote"]) != "") & F.contains(hay, collapse(e["quote"])))


def valid_run_id(run_id: Column) -> Column:
    return F.rlike(run_id, F.lit("^[0-9a-f]{32}$"))


def issue_of(article: Column) -> Column:
    """struct<issue, year, in_range> of an article id."""
    year = F.substring(article, 1, 4).try_cast("int")
    return F.struct(F.substring(article, 1, 7).alias("issue"), year.alias("year"), year.between(1950, 1969).alias("in_range"))
