"""Runs of repeated words: maximal stretches with a small period, found on a Re-Pair grammar of the words.

A slice of texts is compressed by Re-Pair: pairs of neighbouring symbols that occur twice or more get a rule, most frequent
pairs first. A round takes at once all pairs that no more frequent pair overlaps, so there are as many rounds as the grammar is
deep and not as many as it has rules. What is left of a text is halved into a balanced tree. Each nonterminal of either kind
is a place (from, boundary, to) of the text where its expansion occurs first. A run with an exponent of four or more that
crosses the boundary has two whole periods on one side of it, so its period is that of a square that begins or ends there:
places where the words at the boundary come again are the only candidates, and common extensions to both sides, found by
bisecting hashes of prefixes, give the run within the expansion. That is done once per nonterminal; its runs are then
translated to all positions where Re-Pair applied its rule, and intervals with the same period that overlap by a period are
merged. The node that holds a run whole has all of it, so nothing is lost at the ends of expansions.

Hashes are modulo 2^64 and equal words have equal hashes, so a collision can only lengthen a run: every run is compared word
by word at the end, and a text for which one does not hold is searched period by period instead.

Defined results: a null text counts as empty and has no words; null ids are kept and rows that repeat count one by one; a text
is searched whole, whatever its length, in memory in proportion to it; among runs with the same exponent the first, then the
one of smaller period leads; further columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import mix64

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, leading struct<start:long,length:long,period:long>, collapsed string"
MIN_LENGTH, EXPONENT = 6, 4
#: Bytes of text that share a grammar; a longer text has one of its own.
SLICE_BYTES = 1 << 20
#: Candidate periods that are looked at together.
TOGETHER = 1 << 21
#: Words that must come again before a period of this many words or more is looked at; shorter periods are tried one by one.
GRAM = 4
BASE = 0x9E3779B97F4A7C15 | 1


def repair(symbols: np.ndarray, last: np.ndarray):
    """Re-Pair over symbols below ``len(symbols)``; no pair crosses a symbol marked ``last``.

    Returns the rules' occurrences as (rule, position, size of the first part, size) arrays, sorted by rule and position, and the
    positions of what is left with its marks.
    """
    n = len(symbols)
    sym, at, ends = symbols.astype(np.int64), np.arange(n, dtype=np.int64), last.copy()
    active = np.ones(n, dtype=bool)
    next_symbol = int(sym.max()) + 1 if n else 1
    found, rules = [], 0
    while True:
        place = np.flatnonzero(active & ~ends)
        place = place[place < len(sym) - 1]
        if not len(place):
            break
        # In a row of equal symbols only every second pair counts.
        same = sym[place] == sym[place + 1]
        if same.any():
            equal = np.zeros(len(sym), dtype=bool)
            equal[:-1] = (sym[:-1] == sym[1:]) & ~ends[:-1]
            starts = equal.copy()
            starts[1:] &= ~equal[:-1]
            first = np.maximum.accumulate(np.where(starts, np.arange(len(sym)), 0))
            odd = equal & ((np.arange(len(sym)) - first) % 2 == 1)
            place = place[~odd[place]]
        keys = sym[place] * next_symbol + sym[place + 1]
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        kind = np.cumsum(fresh) - 1
        count = np.bincount(kind)
        often = count >= 2
        if not often.any():
            break
        # Priority of pairs: by count, then by a hash, so that long rows of pairs that occur twice are not taken one by one.
        pairs = np.flatnonzero(often)
        rank = np.zeros(len(count), dtype=np.int64)
        rank[pairs[np.lexsort((mix64(ranked[fresh][pairs].view(np.uint64)), count[pairs]))]] = np.arange(1, len(pairs) + 1)
        priority = np.zeros(len(sym) + 1, dtype=np.int64)
        priority[place[order]] = rank[kind]
        mine = priority[:-1]
        chosen = mine > 0
        chosen[1:] &= mine[1:] > mine[:-1]
        chosen &= mine > priority[1:]
        taken = np.bincount(mine[chosen], minlength=len(pairs) + 1) >= 2
        taken[0] = False
        chosen &= taken[mine]
        number = np.cumsum(taken) - 1
        hit = np.flatnonzero(chosen)
        rule = number[mine[hit]]
        end = np.concatenate([at[1:], [n]])
        found.append((rules + rule, at[hit], at[hit + 1] - at[hit], end[hit + 1] - at[hit]))
        changed = np.zeros(len(sym) + 1, dtype=bool)
        changed[hit] = True
        sym[hit] = next_symbol + rule
        ends[hit] = ends[hit + 1]
        # A pair is looked at again where it is new, or occurs twice.
        active[place] &= mine[place] > 0
        keep = np.ones(len(sym), dtype=bool)
        keep[hit + 1] = False
        sym, at, ends, active, changed = sym[keep], at[keep], ends[keep], active[keep], changed[:-1][keep]
        active |= changed
        active[:-1] |= changed[1:]
        rules += int(taken.sum())
        next_symbol += int(taken.sum())
    if found:
        rule, position, first, size = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((position, rule))
        occurrences = tuple(x[order] for x in (rule, position, first, size))
    else:
        occurrences = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return occurrences, at, ends


def halves(at: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, boundary, to) of the balanced trees over what Re-Pair left: neighbours are joined level by level within a text."""
    out = []
    while not ends.all():
        starts = np.concatenate([[True], ends[:-1]])
        index = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
        join = np.flatnonzero((index % 2 == 0) & ~ends)
        stop = np.concatenate([at[1:], [n]])
        out.append((at[join], at[join + 1], stop[join + 1]))
        keep = np.ones(len(at), dtype=bool)
        keep[join + 1] = False
        ends = ends.copy()
        ends[join] = ends[join + 1]
        at, ends = at[keep], ends[keep]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 3


class Extensions:
    """Longest common extensions of places of a text, by hashes of prefixes."""

    def __init__(self, symbols: np.ndarray):
        with np.errstate(over="ignore"):
            self.power = np.full(len(symbols) + 1, BASE, dtype=np.uint64)
            self.power[0] = 1
            np.multiply.accumulate(self.power, out=self.power)
            self.sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
            np.cumsum(mix64(symbols.astype(np.uint64) + np.uint64(1)) * self.power[:-1], out=self.sums[1:])

    def equal(self, a, b, size):
        """Whether ``size`` symbols from ``a`` equal those from ``b``, a <= b."""
        with np.errstate(over="ignore"):
            return (self.sums[a + size] - self.sums[a]) * self.power[b - a] == self.sums[b + size] - self.sums[b]

    def forward(self, a, b, limit):
        low, high = np.zeros(len(a), dtype=np.int64), limit.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a, b, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def backward(self, a, b, limit):
        """Length of the longest common end of what stands before ``a`` and before ``b``."""
        low, high = np.zeros(len(a), dtype=np.int64), limit.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a - middle, b - middle, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low


def _candidates(symbols: np.ndarray, text_of: np.ndarray, lo, mid, hi):
    """Blocks of (node, period, right) where a square may begin at (right) or end at the node's boundary."""
    whole = (hi - lo) // EXPONENT
    for right in (True, False):
        most = np.minimum(whole, (hi - mid if right else mid - lo) // 2)
        for period in range(1, GRAM):
            node = np.flatnonzero(most >= period)
            if len(node):
                yield node, np.full(len(node), period, dtype=np.int64), right
    if len(symbols) < 2 * GRAM:
        return
    # Places of equal GRAM words of one text, numbered by class; each class in order of place.
    n = len(symbols) - GRAM + 1
    inside = np.flatnonzero(text_of[:n] == text_of[GRAM - 1 :])
    with np.errstate(over="ignore"):
        gram = mix64(text_of[inside].astype(np.uint64) + np.uint64(1))
        for k in range(GRAM):
            gram = mix64(gram ^ symbols[inside + k].astype(np.uint64))
    order = np.argsort(gram, kind="stable")
    ranked = gram[order]
    edge = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    alone = edge & np.concatenate([edge[1:], [True]])
    places, kind = inside[order][~alone], (np.cumsum(edge) - 1)[~alone]
    if not len(places):
        return
    rank = np.full(len(symbols), -1, dtype=np.int64)
    rank[places] = np.arange(len(places))
    line = kind * (len(symbols) + 1) + places
    for right in (True, False):
        most = np.minimum(whole, (hi - mid if right else mid - lo) // 2)
        node = np.flatnonzero(most >= GRAM)
        here = mid[node] if right else mid[node] - GRAM
        node, here = node[rank[here] >= 0], here[rank[here] >= 0]
        r = rank[here]
        base = kind[r] * (len(symbols) + 1)
        if right:
            first, until = np.searchsorted(line, base + here + GRAM), np.searchsorted(line, base + here + most[node], "right")
        else:
            first, until = np.searchsorted(line, base + here - most[node]), np.searchsorted(line, base + here - GRAM, "right")
        size = np.maximum(0, until - first)
        ends = np.cumsum(size)
        start = 0
        while start < len(node):
            stop = max(start + 1, int(np.searchsorted(ends, TOGETHER + (ends[start - 1] if start else 0), "right")))
            part = slice(start, stop)
            of = np.repeat(np.arange(start, stop), size[part])
            if len(of):
                step = np.arange(len(of)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
                yield node[of], np.abs(places[first[of] + step] - here[of]), right
            start = stop


def crossing(symbols: np.ndarray, text_of: np.ndarray, lo, mid, hi) -> tuple[np.ndarray, ...]:
    """(node, from, to, period) of runs in an expansion ``lo`` to ``hi`` that cross its boundary ``mid``."""
    long = np.flatnonzero(hi - lo >= MIN_LENGTH)
    if not len(long):
        return (np.zeros(0, dtype=np.int64),) * 4
    lo, mid, hi = lo[long], mid[long], hi[long]
    same = Extensions(symbols)
    out = []
    for node, period, right in _candidates(symbols, text_of, lo, mid, hi):
        a = mid[node] if right else mid[node] - 2 * period
        fits = symbols[a] == symbols[a + period]
        node, period, a = node[fits], period[fits], a[fits]
        fits = same.equal(a, a + period, period)
        node, period, a = node[fits], period[fits], a[fits]
        if not len(node):
            continue
        start = a - same.backward(a, a + period, a - lo[node])
        stop = a + period + same.forward(a, a + period, hi[node] - a - period)
        good = (stop - start >= np.maximum(MIN_LENGTH, EXPONENT * period)) & (start < mid[node]) & (stop > mid[node])
        out.append((long[node[good]], start[good], stop[good], period[good]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 4


def merged(start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals: those of one period that overlap by a period become one; of equal intervals the smallest period stays."""
    if not len(start):
        return start, stop, period
    order = np.lexsort((stop, start, period))
    start, stop, period = start[order], stop[order], period[order]
    wide = int(stop.max()) + 1
    rank = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]]))
    reach = np.maximum.accumulate(rank * wide + stop) - rank * wide
    begins = np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:])])
    first = np.flatnonzero(begins)
    start, period, stop = start[first], period[first], np.maximum.reduceat(stop, first)
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    own = np.concatenate([[True], (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])])
    return start[own], stop[own], period[own]


def by_period(symbols: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, stop, period) of all runs of one text, one period after the other: for texts whose hashes collide."""
    found: list[np.ndarray] = []
    for period in range(1, len(symbols) // EXPONENT + 1):
        same = np.concatenate([[False], symbols[:-period] == symbols[period:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        start, stop = edges[::2], edges[1::2] + period
        good = stop - start >= max(MIN_LENGTH, EXPONENT * period)
        found.append(np.stack([start[good], stop[good], np.full(good.sum(), period)]))
    return list(zip(*(x.tolist() for x in merged(*np.concatenate(found, axis=1))))) if found else []


def runs_of(symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, period) of the runs of several texts that stand one after the other, by start and then period."""
    n = len(symbols)
    if not n:
        return (np.zeros(0, dtype=np.int64),) * 3
    text_of = np.repeat(np.arange(len(length)), length)
    bounds = np.concatenate([[0], np.cumsum(length)])
    last = np.zeros(n, dtype=bool)
    last[bounds[1:][length > 0] - 1] = True
    (rule, position, first_size, size), at, ends = repair(symbols, last)
    begins = np.flatnonzero(np.concatenate([[True], rule[1:] != rule[:-1]])) if len(rule) else np.zeros(0, dtype=np.int64)
    uses = np.diff(np.concatenate([begins, [len(rule)]])) if len(rule) else begins
    lo, mid, hi = halves(at, ends, n)
    n_rules = len(begins)
    node, start, stop, period = crossing(
        symbols, text_of, np.concatenate([position[begins], lo]), np.concatenate([position[begins] + first_size[begins], mid]), np.concatenate([position[begins] + size[begins], hi])
    )
    # A rule's runs hold wherever it was applied; a node of the trees stands for itself.
    shared = node < n_rules
    times = uses[node[shared]]
    of = np.repeat(np.flatnonzero(shared), times)
    step = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    shift = position[begins[node[of]] + step] - position[begins[node[of]]]
    start, stop, period = merged(np.concatenate([start[~shared], start[of] + shift]), np.concatenate([stop[~shared], stop[of] + shift]), np.concatenate([period[~shared], period[of]]))
    holds = np.array([np.array_equal(symbols[a : b - p], symbols[a + p : b]) for a, b, p in zip(start.tolist(), stop.tolist(), period.tolist())], dtype=bool)
    if not holds.all():
        for text in np.unique(text_of[start[~holds]]).tolist():
            a, b = bounds[text], bounds[text + 1]
            plain = np.array(by_period(symbols[a:b]), dtype=np.int64).reshape(-1, 3)
            other = text_of[start] != text
            start, stop, period = (np.concatenate([x[other], y]) for x, y in zip((start, stop, period), (plain[:, 0] + a, plain[:, 1] + a, plain[:, 2])))
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def kept_words(n: int, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, stop, -1)
    return np.cumsum(change[:-1]) == 0


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its number of words, all runs by start and period, the run of greatest exponent (null without runs), and its
    words without repeats, joined by one space."""
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(one)), ("leading", one), ("collapsed", pa.string())])

    def run(batches):
        for batch in batches:
            whole = batch.column(1).fill_null("")
            for at, n in words.slices(batch, whole, SLICE_BYTES):
                values, length = words.split(whole.slice(at, n))
                coded = values.dictionary_encode()
                symbols = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                start, stop, period = runs_of(symbols, length)
                bounds = np.concatenate([[0], np.cumsum(length)])
                kept = kept_words(len(symbols), start, stop, period)
                before = np.concatenate([[0], np.cumsum(kept)])
                texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(before[bounds], pa.int64()), values.filter(pa.array(kept)).cast(pa.large_string())), pa.scalar(" ", pa.large_string()))
                of = np.searchsorted(bounds, start, "right") - 1
                first = np.searchsorted(of, np.arange(n + 1))
                inner = [pa.array(x, pa.int64()) for x in (start - bounds[of], stop - start, period)]
                runs = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(inner, fields=list(one)))
                leading = [max(some, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"])) if some else None for some in runs.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(length, pa.int64()), runs, pa.array(leading, one), texts.cast(pa.string())], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, RUNS)


def looped_tail(text: Column, start: Column, period: Column) -> Column:
    """``text`` with its words from number ``start`` on replaced by repeats of the ``period`` words there."""
    every = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    rest = F.size(every) - start
    loop = F.flatten(F.array_repeat(F.slice(every, start + 1, period), F.ceil(rest / period).cast("int")))
    return F.array_join(F.concat(F.slice(every, F.lit(1), start), F.slice(loop, F.lit(1), rest)), " ")


#: Periods are distances of equal words; a run is an island of neighbouring places with equal words at one distance.
ORACLE = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: [ascii(substring(doc_id::VARCHAR, k, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) AS h
  FROM documents
), parts AS (
  SELECT doc_id, words, len(words)::BIGINT AS n, h % 10 = 0 AND len(words) > 0 AS looped, h // 10 AS g FROM texts
), places AS (
  SELECT *, CASE WHEN looped THEN g % n ELSE n END AS a, CASE WHEN looped THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM parts
), numbered AS (
  SELECT doc_id, n, i, words[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS w FROM (SELECT *, unnest(range(n)) AS i FROM places)
), meets AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM numbered x JOIN numbered y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM meets) GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM islands WHERE length >= 6 AND length >= 4 * q GROUP BY doc_id, start, length
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_min({'start': start, 'length': length, 'period': period}, (-(length::DOUBLE / period), start, period)) AS best
  FROM runs GROUP BY doc_id
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM numbered ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
