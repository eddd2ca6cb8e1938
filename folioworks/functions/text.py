"""Text functions on columns. Script tables are parameters with Jawi defaults, so the same functions serve other scripts."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Python splits words at these; Java's Unicode white space lacks the last four.
SPACES = r"(?U)[\s\x1c-\x1f]+"


@dataclass(frozen=True)
class Script:
    """Fixed values of one script: letters, equal letters, marks to drop, spelling rules, vowels, prefixes, clitics."""

    letters: str = "ء-غف-يٱ-ۓ"
    same_from: str = "کیىأإآ"
    same_to: str = "كييااا"
    dropped: str = "ً-ٰٟـ‌‍‏‎"
    repeat_mark: str = "٢"
    rules: tuple = (("fa_to_pa", "ف", "ڤ"), ("teh_marbuta_to_teh", "ة", "ت"), ("yeh_hamza_to_alef", "ئ", "ا"))
    vowels: str = "اويءئ"
    clitics: dict = field(default_factory=lambda: {"د": "di", "ك": "ke"})
    prefixes: tuple = (("يڠ", "yang"), ("د", "di"), ("ك", "ke"))
    least_rest: int = 3
    punctuation_from: str = "،؛؟﴿﴾–—"
    punctuation_to: str = ",;?()--"
    digits_from: str = "٠١٢٣٤٥٦٧٨٩"
    edges: str = ".,;:!?()[]{}،؛؟"
    hamza: str = "ء"

    @property
    def word(self) -> str:
        # possessive, as the Java engine would go one call deeper with every hyphen
        return f"[{self.letters}]+(?:-[{self.letters}]+)*+"


JAWI = Script()
LATIN = Script(
    letters="a-z", same_from="", same_to="", dropped="̀", repeat_mark="2", rules=(("ph_to_f", "ph", "f"), ("y_to_i", "y", "i"), ("k_to_c", "k", "c")),
    vowels="aeiou", clitics={"a": "ein", "of": "von"}, prefixes=(("th", "the"), ("an", "an"), ("re", "again")), hamza="'",
)

#: Label spellings that stand for the same printed letter.
LABEL_MAP = (("ڤ", "ف"), ("ک", "ك"), ("ݢ", "ڬ"), ("پ", "ڽ"), ("إ", "ا"), ("⹁", "،"))
#: Letters that standard Arabic OCR lacks, with ta marbuta and fa.
SPECIAL_LETTERS = "ڠڽڬچۏةف"


def unicode_normalise(text: Column, form: str) -> Column:
    """Spark has no Unicode normalisation; this is one vectorised call a batch."""

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return run(text)


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalise_script(text: Column, script: Script = JAWI, composed: bool = False) -> Column:
    """Compatibility form, then marks dropped, then equal letters unified. ``composed`` skips the first step for text known to be in that form."""
    text = text if composed else unicode_normalise(text, "NFKC")
    text = F.regexp_replace(text, f"[{script.dropped}]", "")
    return F.translate(text, script.same_from, script.same_to) if script.same_from else text


def normalise_separator(text: Column, script: Script = JAWI) -> Column:
    return F.translate(text, script.punctuation_from + script.digits_from, script.punctuation_to + "0123456789")


def tokens(text: Column, script: Script = JAWI) -> Column:
    """array<struct<text, is_word, reduplicated>>: word runs and what stands between them, in order."""
    cut = F.split(F.regexp_replace(text, f"({script.word})({script.repeat_mark})?", "\u0001w$1\u0002$2\u0001"), "\u0001")
    parts = F.filter(cut, lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.when(
            F.startswith(p, F.lit("w")) & F.contains(p, F.lit("\u0002")),
            F.struct(F.regexp_extract(p, "^w([^\u0002]*)", 1).alias("text"), F.lit(True).alias("is_word"), (~F.endswith(p, F.lit("\u0002"))).alias("reduplicated")),
        ).otherwise(F.struct(p.alias("text"), F.lit(False).alias("is_word"), F.lit(False).alias("reduplicated"))),
    )


def spelling_variants(word: Column, script: Script = JAWI) -> Column:
    """array<struct<variant, rule>>: the word, each rule alone, then all that apply together; each spelling once."""
    fits = [F.contains(word, F.lit(old)) for _, old, _ in script.rules]
    alone = [F.when(fit, F.struct(F.replace(word, F.lit(old), F.lit(new)).alias("variant"), F.lit(name).alias("rule"))) for fit, (name, old, new) in zip(fits, script.rules)]
    together = word
    for _, old, new in script.rules:
        together = F.replace(together, F.lit(old), F.lit(new))
    names = F.concat_ws("+", *[F.when(fit, name) for fit, (name, _, _) in zip(fits, script.rules)])
    several = sum((fit.cast("int") for fit in fits), F.lit(0)) > 1
    every = F.array_compact(F.array(F.struct(word.alias("variant"), F.lit("exact").alias("rule")), *alone, F.when(several, F.struct(together.alias("variant"), names.alias("rule")))))
    return once(every, lambda found: F.filter(found, lambda v, i: ~F.array_contains(F.transform(F.slice(found, F.lit(1), i), lambda e: e["variant"]), v["variant"])))


def consonant_skeleton(word: Column, script: Script = JAWI) -> Column:
    for _, old, new in script.rules:
        word = F.replace(word, F.lit(old), F.lit(new))
    return F.concat(F.substring(word, 1, 1), F.translate(F.substring(word, 2, 1 << 30), script.vowels, ""))


def normalise_for_comparison(text: Column, composed: bool = False) -> Column:
    """Lower case, punctuation to spaces, white space collapsed."""
    text = text if composed else unicode_normalise(text, "NFKC")
    return collapse(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s\x1c-\x1f-]", " "))


def normalise_label(text: Column, composed: bool = False) -> Column:
    text = text if composed else unicode_normalise(text, "NFC")
    return collapse(F.translate(text, "".join(a for a, _ in LABEL_MAP), "".join(b for _, b in LABEL_MAP)))


def clean_pair(rumi: Column, jawi: Column, script: Script = JAWI, composed: bool = False) -> Column:
    """struct<reason, rumi, jawi>: reason is null for a usable pair, else the first test it fails."""
    quotes, edge = "^['\"]+|['\"]+$", "[" + "".join(f"\\{c}" if ord(c) < 128 else c for c in script.edges) + "]+"
    edges, marks = f"^{edge}|{edge}$", f"['\"{script.hamza}]+"
    quoted = lambda t: F.regexp_replace(t["r"], quotes, "") != t["r"]
    bare = once(F.struct(strip(rumi).alias("r"), strip(jawi).alias("j")), lambda t: F.when(quoted(t), F.regexp_replace(t["j"], f"^{marks}|{marks}$", "")).otherwise(t["j"]))
    r = F.lower(F.regexp_replace(F.regexp_replace(strip(rumi), quotes, ""), edges, ""))
    j = F.regexp_replace(normalise_script(bare, script, composed), edges, "")
    hyphens = lambda c: F.length(c) - F.length(F.replace(c, F.lit("-"), F.lit("")))

    def judged(t: Column) -> Column:
        reason = (
            F.when((t["rumi"] == "") | (t["jawi"] == "") | t["rumi"].isNull() | t["jawi"].isNull(), "empty")
            .when(~F.rlike(t["rumi"], F.lit("^[a-z]+(-[a-z]+)*$")), "rumi_not_alphabetic")
            .when(~F.rlike(t["jawi"], F.lit(f"^{script.word}$")), "jawi_not_letters")
            .when(hyphens(t["rumi"]) != hyphens(t["jawi"]), "hyphen_mismatch")
        )
        return F.struct(reason.alias("reason"), t["rumi"].alias("rumi"), t["jawi"].alias("jawi"))

    return once(F.struct(r.alias("rumi"), j.alias("jawi")), judged)


def text_stats(text: Column) -> Column:
    """struct<chars, words, lines>, all 0 for an empty text."""
    t = F.coalesce(text, F.lit(""))
    words = F.when(collapse(t) == "", 0).otherwise(F.size(F.split(collapse(t), " ")))
    lines = F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)
    return F.struct(F.length(t).alias("chars"), words.alias("words"), lines.alias("lines"))


def script_fraction(text: Column, block: str = r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿") -> Column:
    """Share of letters that are of one script; 0 without letters."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", "")
    own = F.length(letters) - F.length(F.regexp_replace(letters, f"[{block}]", ""))
    return F.when(F.length(letters) > 0, own / F.length(letters)).otherwise(0.0)


def cell_lines(cell: Column) -> Column:
    """The non-blank trimmed lines of a cell."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), "\n"), strip), lambda x: x != "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def parse_saved_text(content: Column) -> Column:
    """struct<text, metadata> of a saved OCR text: leading banner lines go; ``key: value`` lines follow the metadata mark."""
    parts = F.split(content, "=== Metadata ===", 2)
    body = strip(F.regexp_replace(F.get(parts, F.lit(0)), r"^(\s*===[^\n]*(\n|$))+", ""))
    lines = F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(slug(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.transform(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"]), p["k"]))
    return F.struct(body.alias("text"), F.map_from_entries(last).alias("metadata"))


#: Fixed values: (mark, provider) by what a file name or a text contains, the first that fits; and what is left.
NAME_MARKS = (("qwen", "qwen-fixture"), ("kraken", "kraken-fixture"), ("tesseract", "tesseract"), ("ocr_output", "tesseract"))
CONTENT_MARKS = (("jawi llm-ocr result (qwen)", "qwen-fixture"), ("jawi llm-ocr result (kraken)", "kraken-fixture"), ("jawi ocr result", "tesseract"))
NO_PROVIDER = "text-fixture"


def infer_provider(metadata: Column, file_name: Column, content: Column, default: str = NO_PROVIDER) -> Column:
    """The provider that metadata names, else what the file name tells, else the content, else the default."""
    picks = [F.when(F.contains(F.lower(source), F.lit(mark)), name) for source, marks in ((file_name, NAME_MARKS), (content, CONTENT_MARKS)) for mark, name in marks]
    return F.coalesce(F.lower(metadata["provider"]), *picks, F.lit(default))


def normalise_output(text: Column) -> Column:
    """NFC, and white space collapsed; nothing else changes."""
    return collapse(unicode_normalise(F.coalesce(text, F.lit("")), "NFC"))


def safe_name(text: Column, default: str = "document") -> Column:
    """A document name that is safe as a file name: runs of other characters than letters, digits, dots and hyphens become ``_``."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}.\-]+", "_"), "^[._]+|[._]+$", ""), F.lit("")), F.lit(default))


def distinct_in_order(items: Column) -> Column:
    """Stripped members without blanks, each once, where it comes first."""
    return F.array_distinct(F.filter(F.transform(items, strip), lambda x: x != ""))


def spreadsheet_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/d/([A-Za-z0-9_-]+)", 1), F.lit(""))


def article_of_title(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, r"(\d{4}_\d{2}_\d{3})", 1), F.lit(""))


def page_key(article: Column, page: Column) -> Column:
    return F.format_string("%s_p%02d", article, page)


def crop_name(article: Column, page: Column, line: Column) -> Column:
    return F.format_string("%s_p%02d_line_%03d.png", article, page, line)


def dataset_line_name(article: Column, page: Column, line: Column) -> Column:
    return F.format_string("%s_p%02d_l%03d.png", article, page, line)


def new_repeat_run(pred: Column, gold: Column, least: int = 5, of: str = ".") -> Column:
    """True when ``pred`` has a run of ``least`` equal characters or more that ``gold`` does not contain. ``of`` (a pattern of one
    character) says which characters count, by default all."""
    runs = F.regexp_extract_all(pred, F.lit(rf"(?s)(({of})\2{{{least - 1},}})"), F.lit(1))
    return F.exists(runs, lambda r: ~F.contains(gold, r))


def normalise_entity(text: Column) -> Column:
    return collapse(F.lower(text))
