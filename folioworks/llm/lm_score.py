"""Cross-entropy difference of texts under matched target and background bigram models.

Both models share the whole vocabulary of the corpus, and every bigram of it has its own count: the models grow with the
input and are never gathered in one place. The background model counts all texts, the target model those marked as
target. Bigrams are smoothed towards each model's unigrams with Dirichlet weight ``KAPPA``, unigrams by adding one half
for each word; a vocabulary of fewer than ``SIZE - 1`` words keeps the other places for words not seen.

A text's score is the mean over its tokens of the loss under the target model minus that under the background model, in
bits: the lower, the more target-like. The loss of a bigram (v, w) is
``log2(count(v) + KAPPA) - log2(count(v, w) + KAPPA * share(w))``.

Rows are dealt to chunks of about ``CHUNK_BYTES`` of text. A chunk counts its distinct words, contexts and bigrams and sends
each range of their hashes, with the counts, to the bucket of that range. A bucket adds up what the chunks sent and returns
to each the totals in the order in which it sent the hashes, with its share of the sums over all words. So each key of a chunk
is moved once, however often it occurs, a frequent word weighs no more than a rare one, and no task holds more than a chunk
or a bucket. The chunk then looks its tokens up in the totals.

Keys travel as compressed steps from one to the next. Words, contexts and bigrams are told apart by hashes of 56 bits: of n
keys a share of about n / 2^56 coincides with another (one in 70,000 of a million million).

Defined results: null and wordless texts have 0 tokens and null losses and score; without target texts both models are
equal up to smoothing; rows without an id are never target; repeated rows count as often as they occur, and rows of an id
that very many share are dealt like others; a very long text is a chunk's, in memory in proportion to it; an empty table
gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

KAPPA = 8.0
#: Places that the smoothing of unigrams counts at least: the start and others.
SIZE = 1_536
CHUNK_BYTES = 8 << 20
#: Bits of a key: with n keys in the corpus a share of about n / 2^(KEY_BITS - 2) of them is counted together with another.
KEY_BITS = 58
#: Rows of one id from which they are dealt to ``SALTS`` chunks; at most one in ``OFTEN`` rows has such an id of its own.
OFTEN, SALTS = 10_000, 64
#: The low bits of a key tell bigrams, words and contexts apart.
KIND, BIGRAM, WORD, CONTEXT = np.uint64(3), np.uint64(0), np.uint64(1), np.uint64(2)
START = np.uint64(0x5851F42D4C957F2D)


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


class _Counted:
    """The keys of a chunk in ascending order, and where each token's bigram is among them."""

    def __init__(self, texts: list[str | None]):
        codes: dict[str, int] = {}
        parts, sizes = [], []
        for text in texts:
            words = tokens(text)
            parts.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=len(words)))
            sizes.append(len(words))
        self.sizes = np.array(sizes, dtype=np.int64)
        self.word = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        self.start = len(codes)  # the code of what stands before the first token
        self.before = np.r_[self.start, self.word[:-1]][: len(self.word)]
        self.before[np.cumsum(np.r_[0, self.sizes[:-1]])[self.sizes > 0]] = self.start
        pairs, self.pair = np.unique(self.before * (self.start + 1) + self.word, return_inverse=True)
        self.pair_before, self.pair_word = np.divmod(pairs, self.start + 1)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in codes), dtype=np.uint64, count=len(codes))
        hashes = np.r_[hashes, START]
        with np.errstate(over="ignore"):
            both = mix64(hashes[self.pair_before] * np.uint64(3) + mix64(hashes[self.pair_word]))
        kinds = ((mix64(hashes[:-1]), WORD), (mix64(hashes), CONTEXT), (both, BIGRAM))
        keys = np.concatenate([(h >> np.uint64(64 - KEY_BITS)) & ~KIND | kind for h, kind in kinds])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def counts(self, of: np.ndarray | None = None) -> np.ndarray:
        """How often each key occurs in all tokens, or in those marked in ``of``."""
        one = slice(None) if of is None else of
        sizes = (self.start, self.start + 1, len(self.pair_word))
        return np.concatenate([np.bincount(x[one], minlength=n) for x, n in zip((self.word, self.before, self.pair), sizes)])[self.order]

    def unsorted(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals in key order, as those of words, of contexts and of bigrams by their codes."""
        by_code = np.empty(len(totals), dtype=np.float64)
        by_code[self.order] = totals
        return by_code[: self.start], by_code[self.start : 2 * self.start + 1], by_code[2 * self.start + 1 :]


def _texts(rows: pa.Table) -> tuple[list[str | None], pa.Array, np.ndarray]:
    """Texts, ids and target marks of a chunk; rows that only mark an id as target go."""
    marks = np.array(rows["mark"].to_pylist(), dtype=bool)
    wanted = set(rows["doc_id"].filter(pa.array(marks)).to_pylist())
    docs = rows.filter(pa.array(~marks))
    ids = docs["doc_id"]
    return docs["text"].to_pylist(), ids, np.array([i in wanted for i in ids.to_pylist()], dtype=bool)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed bytes: the lowest bytes of all, then the next ones, as many as the largest needs."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    wide[:, : data[0]] = planes.T
    return wide.view("<u8").reshape(-1)


SENT = "bucket int, chunk int, keys binary, background binary, target binary"
RETURNED = "bucket int, chunk int, background binary, target binary, words long, background_tokens long, target_tokens long"


def _steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as the first and the steps from each to the next."""
    return np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys


def _sender(n: int):
    edges = (np.arange(1, n, dtype=object) * (1 << KEY_BITS) // n).astype(np.uint64)

    def send(rows: pa.Table) -> pa.Table:
        texts, _, target = _texts(rows)
        found = _Counted(texts)
        cuts = np.r_[0, np.searchsorted(found.keys, edges), len(found.keys)]
        m = n if len(found.word) else 0  # a chunk with tokens hears of every bucket, for the sums
        chunk = rows["chunk"][0].as_py()
        counts = found.counts(), found.counts(np.repeat(target, found.sizes))
        parts = [slice(cuts[i], cuts[i + 1]) for i in range(m)]
        columns = [pa.array([packed(_steps(found.keys[p])) for p in parts], pa.binary()), *(pa.array([packed(c[p]) for p in parts], pa.binary()) for c in counts)]
        return pa.table([pa.array(np.arange(m), pa.int32()), pa.array(np.full(m, chunk), pa.int32()), *columns], [f.split()[0] for f in SENT.split(", ")])

    return send


def _add_up(rows: pa.Table) -> pa.Table:
    """The totals of a bucket's keys, for each chunk in its order."""
    sent = [np.cumsum(unpacked(x), dtype=np.uint64) for x in rows["keys"].to_pylist()]
    cuts = np.cumsum([len(x) for x in sent])[:-1]
    keys, at = np.unique(np.concatenate(sent), return_inverse=True)
    del sent
    word, sums, columns = (keys & KIND) == WORD, [], []
    for name in ("background", "target"):
        counts = np.concatenate([unpacked(x) for x in rows[name].to_pylist()])
        totals = np.bincount(at, counts, len(keys)).astype(np.uint64)  # whole numbers under 2^53
        sums.append(int(totals[word].sum()))
        columns.append(pa.array([packed(totals[x]) for x in np.split(at, cuts)], pa.binary()))
    same = [pa.array(np.full(rows.num_rows, x), pa.int64()) for x in (int(word.sum()), *sums)]
    return pa.table([rows["bucket"], rows["chunk"], *columns, *same], [f.split()[0] for f in RETURNED.split(", ")])


SCORED = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"


def _scored(rows: pa.Table, totals: pa.Table) -> pa.Table:
    """The losses of a chunk's rows from the totals that the buckets returned."""
    texts, ids, _ = _texts(rows)
    found = _Counted(texts)
    totals = totals.sort_by("bucket")
    owner, sums = np.repeat(np.arange(len(texts)), found.sizes), []
    for name in ("target", "background"):
        held = np.concatenate([unpacked(x) for x in totals[name].to_pylist()] or [np.zeros(0, dtype=np.uint64)])
        if len(held) != len(found.keys) and len(found.word):
            raise ValueError("a chunk has other rows than when it was counted")
        if not len(found.word):
            sums.append(np.zeros(len(texts)))
            continue
        word, context, bigram = found.unsorted(held)
        tokens_, words = (int(totals[c].to_numpy().sum()) for c in (f"{name}_tokens", "words"))
        share = (word + 0.5) / (tokens_ + 0.5 * max(words, SIZE - 1))
        loss = np.log2(context[found.pair_before] + KAPPA) - np.log2(bigram + KAPPA * share[found.pair_word])
        sums.append(np.bincount(owner, loss[found.pair], len(texts)))
    with np.errstate(invalid="ignore", divide="ignore"):
        target, background = (s / found.sizes for s in sums)
    none = found.sizes == 0
    means = [pa.array(x, pa.float64(), mask=none) for x in (target, background, target - background)]
    return pa.table([ids, pa.array(found.sizes), *means], [f.split()[0] for f in SCORED.split(", ")])


def _dealt(docs: DataFrame, target_ids: DataFrame) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text, mark): rows by chunk, with a row for each target id in the chunks that its rows may be in."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // CHUNK_BYTES))
    often = docs.filter("doc_id is not null").groupBy("doc_id").count().filter(F.col("count") >= OFTEN).select("doc_id", F.lit(SALTS).alias("salts"))
    place = lambda salt: F.pmod(F.xxhash64("doc_id", salt), F.lit(n)).cast("int").alias("chunk")
    row = F.monotonically_increasing_id()
    # an id that is missing is spread over all chunks, one that very many rows share over SALTS
    numbered = docs.withColumn("row", row).join(F.broadcast(often), "doc_id", "left")  # at most one in OFTEN rows
    salt = F.when(F.col("doc_id").isNull(), F.col("row")).when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("row"), F.col("salts"))).otherwise(F.lit(0)).cast("long")
    texts = numbered.withColumn("salt", salt).select(place("salt"), "doc_id", "text", F.lit(False).alias("mark"))
    marks = target_ids.join(F.broadcast(often), "doc_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("salts", F.lit(1)) - 1).cast("long"))))
    return texts.unionByName(marks.select(place("salt"), "doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("mark"))), n


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, loss_target, loss_background, score; the target texts are those whose id is in
    ``target_ids``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = target_ids.select(F.col(id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    dealt, n = _dealt(rows, wanted)
    chunks = dealt.groupBy("chunk")
    totals = chunks.applyInArrow(_sender(n), SENT).groupBy("bucket").applyInArrow(_add_up, RETURNED)
    return chunks.cogroup(totals.groupBy("chunk")).applyInArrow(_scored, SCORED)
