"""Best-fit packing of tokenised documents into sequences of bounded length, certified by lower bounds.

``token_pieces`` turns texts into pieces; ``pack`` places pieces. Packing runs per salted group: best-fit decreasing
fills bins, dual feasible functions bound from below how many bins that group needs, and a group whose count exceeds its
bound (a gap) hands the pieces of its unfilled bins to the next round, where they meet those of other groups.

Rounds end when the bins that are left are certified by the bound of all their pieces together, or a round gains none.

Defined results: a null text counts as empty and yields one piece that holds only the end id; null ids are kept, and
repeated rows are packed as often as they occur; ties go to the row with the smaller id; a very long text is encoded whole,
in memory in proportion to it; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, salt_count

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PER_GROUP = 20_000
#: Bound of the ids of words that are kept, in bytes of words and ids; they are dropped at the end of each task.
CACHED_BYTES = 32 << 20
#: The tokenizer lower-cases, composes and splits texts in words before it merges. For texts of these characters alone the
#: words can be found here: nothing composes, lower case keeps one letter for one, and white space is the same.
PLAIN = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u017f]|<\\|")
#: The fixed pattern of the tokenizer's splitter, over plain lower-case characters.
WORDS = re.compile(r"[a-zªµºß-öø-ÿĀ-ſ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿĀ-ſ0-9²³¹¼-¾]+")

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of whole texts. Merges never cross words, so the ids of words are kept, in bounded memory."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.kept = 0

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encodes many words at once; each token tells which word it is of."""
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, of = np.array(got.ids, dtype="<u4").tobytes(), np.array(got.word_ids)
        ends = (4 * np.searchsorted(of, np.arange(len(words)), "right")).tolist()
        if len(of) and of[-1] != len(words) - 1:
            raise ValueError("the tokenizer splits words otherwise")
        self.known.update((w, ids[a:b]) for w, a, b in zip(words, [0, *ends], ends))
        self.kept += sum(map(len, words)) + len(ids)

    def forget(self) -> None:
        self.known.clear()
        self.kept = 0

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.kept > CACHED_BYTES:
            self.forget()
        words = [None if PLAIN.search(t) else WORDS.findall(t.lower()) for t in texts]
        new = [w for w in set().union(*(w for w in words if w)) if w not in self.known]
        for at in range(0, len(new), 4096):
            self._learn(new[at : at + 4096])
        look = self.known.__getitem__
        return [self._whole(t) if w is None else b"".join(map(look, w)) for t, w in zip(texts, words)]


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: only a document longer than ``size`` ids is cut."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keys, rows = part.column(0).to_pylist(), []
                for key, ids in zip(keys, enc.ids([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * size)):
                        cut = ids[start : start + 4 * size]
                        rows.append((key, k, start // 4, len(cut) // 4, zlib.crc32(cut)))
                yield record_batch(rows)
        enc.forget()

    def record_batch(rows):
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(pieces, PIECES)


def dual_bound(lengths: np.ndarray, size: int) -> int:
    """The lower bound of bins of ``size`` for items of these lengths."""
    return _dual_bound(np.bincount(lengths, minlength=size + 1).astype(np.int64), size)


def _dual_bound(count: np.ndarray, size: int) -> int:
    """The best of a family of dual feasible functions: no packing into bins of ``size`` uses fewer bins.

    Thresholding keeps large items whole and drops small ones; rounding by k turns an item x into floor((k + 1) x) / k.
    Both are also applied one after the other.
    """
    value = np.arange(size + 1, dtype=np.int64)
    total, n = np.cumsum(count * value), np.cumsum(count)
    best = -(-int(total[-1]) // size)
    cuts = [0, *np.flatnonzero(count[: size // 2 + 1]).tolist()]
    for e in cuts:  # items over size - e count as a whole bin, items under e as nothing
        middle = int(total[size - e] - (total[e - 1] if e else 0))
        best = max(best, int(n[size] - n[size - e]) - (-middle // size))
    for k in range(1, 25):
        scaled = (k + 1) * value
        rounded = np.where(scaled % size == 0, value * k, (scaled // size) * size)  # over k * size
        best = max(best, -(-int((count * rounded).sum()) // (k * size)))
        for e in cuts[:: max(1, len(cuts) // 32)]:
            both = np.where(value > size - e, k * size, np.where(value < e, 0, rounded))
            best = max(best, -(-int((count * both).sum()) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, list[int]]:
    """The bin of every item, the longest first, each into the fullest bin that takes it; and the room left in each bin."""
    where, room, open_bins, mask = np.zeros(len(lengths), dtype=np.int64), [], [[] for _ in range(size + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                mask &= ~(1 << left)
        else:
            b, left = len(room), size
            room.append(size)
        left -= need
        room[b] = left
        where[i] = b
        if left:
            open_bins[left].append(b)
            mask |= 1 << left
    return where, room


PACKED = PIECES + ", sequence_id long, offset long, bound long, bins long, kept boolean"


def _placer(size: int, turn: int, last: bool):
    """Packs one salted group; ``kept`` marks the rows whose place is final."""

    def place(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")], null_placement="at_start"))
        lengths = group["length"].to_numpy()
        where, room = best_fit_decreasing(lengths, size)
        bound, room = dual_bound(lengths, size), np.array(room)
        if last:
            kept = np.ones(len(room), dtype=bool)
        elif len(room) == bound:  # certified: only the emptiest bin may still gain from others
            kept = np.arange(len(room)) != int(room.argmax())
            kept |= room == 0
        else:
            kept = room == 0
        order = np.argsort(where, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.r_[True, np.diff(where[order]) != 0]
        base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        offset = np.empty(group.num_rows, dtype=np.int64)
        offset[order] = ends - lengths[order] - base
        seq = (np.int64(turn) << 56) + (np.int64(group["salt"][0].as_py()) << 24) + where
        names = [f.split()[0] for f in PIECES.split(", ")]
        same = [pa.array(np.full(group.num_rows, n, dtype=np.int64)) for n in (bound, len(room))]
        return pa.table([*(group[c] for c in names), pa.array(seq), pa.array(offset), *same, pa.array(kept[where])], [f.split()[0] for f in PACKED.split(", ")])

    return place


def total_bound(pieces: DataFrame, size: int) -> int:
    """The dual bound of all pieces together, from how many there are of each length (at most ``size`` rows)."""
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    held = np.zeros(size + 1, dtype=np.int64)
    for r in counts:
        held[r["length"]] = r["n"]
    return _dual_bound(held, size)


def pack(pieces: DataFrame, size: int = 4096, per_group: int = PER_GROUP) -> DataFrame:
    """Adds sequence_id, the offset in it, and the certificate: the bound and the bin count of the group that placed it.

    Rounds go on until the bins that are left over are certified by the dual bound of all their pieces, one group holds them
    all, or a round has no fewer bins than they had before.
    """
    done: DataFrame | None = None
    pool, turn, had = materialise(pieces, "pieces"), 0, None
    while True:
        groups = salt_count(pool.count(), per_group)
        # rows are dealt by their place in the table, so rows that repeat one id are dealt like others
        salted = pool.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(groups)))
        placed = materialise(salted.groupBy("salt").applyInArrow(_placer(size, turn, groups == 1), PACKED), "placed")
        rest = placed.filter("not kept")
        now, left = _bins(placed), _bins(rest)
        final = left == 0 or (had is not None and now >= had) or total_bound(rest, size) == left
        kept = (placed if final else placed.filter("kept")).drop("kept")
        done = kept if done is None else done.unionByName(kept)
        if final:
            return done
        pool, turn, had = rest.select("doc_id", "piece", "start", "length", "ids_crc32"), turn + 1, left


def _bins(placed: DataFrame) -> int:
    return placed.agg(F.count_distinct("sequence_id")).first()[0]
