"""Language identification by cross-parsing entropy over suffix automata.

Training: labelled texts are cut in pieces of ``PIECE`` characters, and per language the ``SAMPLE_PIECES`` distinct pieces of
least hash make one suffix automaton. This is the documented bound of the sample: every piece of every labelled text may be
in it, wherever it stands and however long its text is, and copies of a piece count once.

Prediction: a whole text is cut greedily in phrases, each the longest match in the automaton from where the last one ended;
a byte that the sample does not have is a phrase of its own. The language that needs the fewest phrases, each weighted by
the logarithm of its sample's size, wins. Ties go to the language that sorts first.

Texts are parsed as UTF-8, in lower case, every word behind one space; all that is no letter only separates words. Phrases
span words. Texts of a slice are parsed side by side in segments: each segment is walked from the start state, then again
from the state in which the segment before it ended, until both walks are in one state, from where on they agree. The few
walks that never agree within a segment are followed to their end one by one, so counts are those of one walk of the text.

Defined results: null, empty and letterless texts get ``und`` with score 0; without any labelled text every row is
``und``; repeated rows are predicted alike; very long texts are parsed whole, in memory in proportion to the longest text;
an empty table gives no rows; further columns are ignored, whatever their names. The row's own label, id and source are never
looked at when predicting.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Bounds of the training sample: pieces per language and characters per piece.
SAMPLE_PIECES = 32
PIECE = 1_000
#: Groups in which the pieces of a language are ranked before they are ranked together.
SALTS = 64
SEGMENT = 512
SLICE_CHARS = 1 << 20

_LETTERS = re.compile(r"[^\W\d_]+")
_is_letter: list[np.ndarray] = []


def letters(text: str | None) -> list[str]:
    """The words of a text: runs of letters, in lower case."""
    return _LETTERS.findall((text or "").lower())


def _letter_table() -> np.ndarray:
    """Which code points are letters; about 1 MB."""
    if not _is_letter:
        _is_letter.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _is_letter[0]


def normalised(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """All texts as one run of UTF-8 bytes, each word behind one space, and where each text ends in it."""
    marked = [" " + (t or "").lower() for t in texts]
    bounds = np.cumsum([len(t) for t in marked])
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letter_table()[points]
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # every text starts with a space, so the place before a word is of the same text
    points = np.where(letter, points, 0x20)[keep]
    ends = np.r_[0, np.cumsum(keep)][bounds]
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    data = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return data, np.r_[0, np.cumsum(width)][ends]


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The transitions of each state by byte; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    links, lengths, last = [-1], [0], 0
    for c in data:
        current = len(moves)
        moves.append({})
        links.append(0)
        lengths.append(lengths[last] + 1)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = current
            p = links[p]
        if p != -1:
            q = moves[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[current] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = links[p]
                links[q] = links[current] = clone
        last = current
    return moves


class Model:
    """The automata of all languages as flat transition lists, small enough to broadcast: their size is that of the sample."""

    def __init__(self, sample: dict[str, str]):
        self.languages, self.bits, self.automata = [], [], []
        for lang, text in sorted(sample.items()):
            data = normalised([text])[0]
            if data:
                moves = suffix_automaton(data)
                flat = np.array([(s, c, to) for s, m in enumerate(moves) for c, to in m.items()], dtype=np.int32)
                self.languages.append(lang)
                self.bits.append(math.log2(2 + len(data)))
                self.automata.append((len(moves), flat))


class Parser:
    """Cross-parses texts with every language's automaton."""

    def __init__(self, model: Model):
        self.languages, self.bits = model.languages, np.array(model.bits)
        used = sorted({int(c) for _, flat in model.automata for c in np.unique(flat[:, 1])})
        self.wide = len(used) + 2  # a class for the end of a text and one for bytes of no sample
        self.classes = np.full(256, self.wide - 1, dtype=np.uint8 if self.wide <= 256 else np.uint16)
        self.classes[used] = np.arange(1, len(used) + 1)
        states = sum(n for n, _ in model.automata)
        kind = np.int32 if 4 * states * self.wide < 1 << 31 else np.int64
        #: Per state and class: where to go (times 4, as an offset in this table), plus the phrases that end on the way.
        self.table = np.empty((states, self.wide), dtype=kind)
        self.roots, first = [], 0
        for n, flat in model.automata:
            part = self.table[first : first + n]
            root = first * self.wide
            start = np.full(self.wide, -1, dtype=np.int64)
            mine = flat[flat[:, 0] == 0]
            start[self.classes[mine[:, 1]]] = (first + mine[:, 2].astype(np.int64)) * self.wide
            part[:] = np.where(start >= 0, 4 * start + 1, 4 * root + 2)
            part[0] = np.where(start >= 0, 4 * start, 4 * root + 1)
            part[flat[:, 0], self.classes[flat[:, 1]]] = 4 * (first + flat[:, 2].astype(np.int64)) * self.wide
            part[:, 0] = 4 * (first + np.arange(n, dtype=np.int64)) * self.wide
            self.roots.append(root)
            first += n
        self.table = self.table.reshape(-1)

    def _walk(self, codes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walks all lanes one class at a time; returns the phrases that ended and the last states."""
        kind = self.table.dtype  # one type throughout, so that no step converts
        n, at, value, state = np.zeros(state.shape, kind), np.empty(state.shape, kind), np.empty(state.shape, kind), state.astype(kind)
        for row in codes:
            np.add(state, row.astype(kind), out=at)
            np.take(self.table, at, out=value, mode="clip")
            np.right_shift(value, 2, out=state)
            np.bitwise_and(value, 3, out=value)
            np.add(n, value, out=n)
        return n, state

    def phrases(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        """Phrases per language and text."""
        starts = np.r_[0, ends[:-1]]
        segments = -(-(ends - starts) // SEGMENT)
        total, texts = int(segments.sum()), len(ends)
        owner = np.repeat(np.arange(texts), segments)
        place = np.arange(total) - np.repeat(np.cumsum(segments) - segments, segments)
        classes = self.classes[np.frombuffer(data, dtype=np.uint8)]
        spots = (starts[owner] + place * SEGMENT)[:, None] + np.arange(SEGMENT)
        codes = np.where(spots < ends[owner][:, None], classes[np.minimum(spots, max(0, len(classes) - 1))] if len(classes) else 0, 0).T.copy()
        roots = np.array(self.roots, dtype=np.int64)[:, None]
        n, last = self._walk(codes, np.broadcast_to(roots, (len(roots), total)))
        n, alone = n.astype(np.int64), n
        lang, seg = (x.reshape(-1) for x in np.meshgrid(np.arange(len(roots)), np.flatnonzero(place > 0), indexing="ij"))
        true, guess = last[lang, seg - 1], np.broadcast_to(roots, last.shape)[lang, seg]
        for first in range(0, SEGMENT, 16):
            apart = true != guess
            lang, seg, true, guess = lang[apart], seg[apart], true[apart], guess[apart]
            if not len(seg):
                break
            part = codes[first : first + 16][:, seg]
            more, true = self._walk(part, true)
            less, guess = self._walk(part, guess)
            np.add.at(n, (lang, seg), more.astype(np.int64) - less)
        apart = true != guess
        if apart.any():
            self._follow(codes, owner, alone, n, last, lang[apart], seg[apart], true[apart])
        ended = np.zeros((len(roots), texts), dtype=np.int64)
        np.add.at(ended, (slice(None), owner), n)
        final = np.flatnonzero(np.r_[owner[1:] != owner[:-1], True][:total])
        ended[:, owner[final]] += last[:, final] != roots
        return ended

    def _follow(self, codes, owner, alone, n, last, lang, seg, state) -> None:
        """Corrects ``n`` and ``last`` after segments whose walks did not meet, along their texts until they do; ``alone`` are
        the phrases of each segment walked from the start state."""
        table, wide = memoryview(self.table), n.shape[1]
        ends = dict(zip(zip(lang.tolist(), seg.tolist()), state.tolist()))
        done = set()
        for k, s in sorted(ends):
            if (k, s) in done:
                continue
            true = ends[k, s]
            last[k, s] = true
            while s + 1 < wide and owner[s + 1] == owner[s]:
                s += 1
                done.add((k, s))
                guess, more = self.roots[k], 0
                for c in codes[:, s].tolist():
                    a, b = table[true + c], table[guess + c]
                    more += (a & 3) - (b & 3)
                    true, guess = a >> 2, b >> 2
                    if true == guess:
                        break
                n[k, s] = alone[k, s] + more
                if true == guess:
                    break
                last[k, s] = true

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per byte that each language needs for each text, and the bytes of each text."""
        data, ends = normalised(texts)
        size = np.diff(np.r_[0, ends])
        return self.phrases(data, ends) * self.bits[:, None] / np.maximum(1, size), size

    def judge(self, texts: list[str | None], labels: list[str | None]) -> list[tuple[str, float, float | None]]:
        """Per text its language, the score, and by which share that is cheaper than the labelled language (None without a model)."""
        if not self.languages:
            return [(UNKNOWN, 0.0, None)] * len(texts)
        costs, size = self.costs(texts)
        out = []
        for column, n, label in zip(costs.T.tolist(), size.tolist(), labels):
            if not n:
                out.append((UNKNOWN, 0.0, None))
                continue
            ranked = sorted(zip(column, self.languages))
            best = ranked[0][0]
            own = next((1.0 - best / cost for cost, lang in ranked if lang == label), None)
            score = 1.0 if len(ranked) == 1 else 1.0 - best / ranked[1][0]
            out.append((ranked[0][1], max(0.0, min(1.0, score)), own))
        return out


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``SLICE_CHARS`` characters together; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or "") > SLICE_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def training_sample(labelled: DataFrame, text_col: str, lang_col: str, pieces: int = SAMPLE_PIECES, size: int = PIECE) -> dict[str, str]:
    """Per language its ``pieces`` distinct pieces of least hash."""
    cut = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    every = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), cut.alias("piece"))
    every = every.select("lang", F.xxhash64("piece").alias("h"), "piece").filter(F.col("piece").rlike(r"\p{L}"))
    least = every.select("lang", "h").distinct()
    for groups in (["lang", F.pmod(F.hash("h"), F.lit(SALTS))], ["lang"]):  # no task ranks all pieces of a language
        least = least.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy("h"))).filter(F.col("rank") <= pieces).drop("rank")
    picked = every.join(F.broadcast(least), ["lang", "h"]).dropDuplicates(["lang", "h"]).collect()  # ``pieces`` rows per language
    found: dict[str, list] = {}
    for row in picked:
        found.setdefault(row["lang"], []).append((row["h"], row["piece"]))
    return {lang: " ".join(p for _, p in sorted(got)) for lang, got in found.items()}


JUDGED = "lang_pred string, score double, label_margin double"


def judged(model, text: Column, label: Column) -> Column:
    """A struct of lang_pred, score and label_margin (by which share lang_pred is cheaper than ``label``; null where that has
    no model). Only the two columns go to Python. ``model`` is a broadcast Model."""

    @F.arrow_udf(JUDGED)
    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        parser = Parser(model.value)  # lives as long as the task
        for texts, labels in batches:
            said = []
            for first in range(0, len(texts), 1024):
                part, own = texts.slice(first, 1024).to_pylist(), labels.slice(first, 1024).to_pylist()
                for a, b in _slices(part):
                    said += parser.judge(part[a:b], own[a:b])
            columns = list(zip(*said)) or [(), (), ()]
            kinds = (pa.string(), pa.float64(), pa.float64())
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang_pred", "score", "label_margin"])

    return judge(text, label)


def held_out(id_col: str) -> Column:
    """True for the fifth of rows that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """The broadcast model of the labelled rows that are not held out."""
    sample = training_sample(docs.filter(~held_out(id_col)), text_col, lang_col)
    return docs.sparkSession.sparkContext.broadcast(Model(sample))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the labelled rows that are not held out and predicts every row: doc_id, held_out, lang_pred, score."""
    said = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), judged(fit(docs, id_col, text_col, lang_col), F.col(text_col), F.lit(None).cast("string")).alias("said"))
    return said.select("doc_id", "held_out", "said.lang_pred", "said.score")
