"""Media columns over a content-defined chunk store.

A payload becomes an 8-bit mono WAV file; the file's bytes are cut where a rolling gear hash over the last 32 bytes has
``CUT_BITS`` leading zeros (at least ``LEAST`` and at most ``MOST`` bytes apart), and chunks are known by their SHA-256.
The manifest lists each medium's chunks in order. Spark joins on digests find the chunks that occur more than once: a
medium of chunks that occur nowhere else is stored in one row, in place; all other chunks go to a shared table with one row
per digest. Reading joins the ordered list with the stored chunks, checks every digest and the digest of the whole.

Defined results: a null text counts as empty; an empty payload is one block of padding; equal texts share one medium;
repeated rows give equal rows, and of equal chunks any copy serves, as their bytes are the same; a very long text is one payload,
cut whole in memory in proportion to it; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bloom, bloom_of, materialise, new_path

BLOCK = 576
PAD = 255
RATE = 8_000
CUT_BITS = 13
LEAST, MOST = 2_048, 65_536
HEADER = 44
#: References to stored chunks are counted by hash in this many counters, a table that is broadcast whole.
COUNTERS = 1 << 16
#: References to one chunk that meet it in one place, or four times a counter's mean where that is more.
PER_PLACE = 1_000

_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def payload_of(raw: bytes) -> bytes:
    size = max(BLOCK, -(-len(raw) // BLOCK) * BLOCK)
    return raw + bytes([PAD]) * (size - len(raw))


def wav(payload: bytes) -> bytes:
    """Unsigned 8-bit mono samples, one per payload byte."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples(media: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def cut_places(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for shift in (1, 2, 4, 8, 16):  # doubles the window that the hash at each byte covers, up to 32 bytes
        h[shift:] += h[:-shift] << np.uint32(shift)
    found, ends, last = (np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + 1).tolist(), [], 0
    for p in found:
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST:
            ends.append(p)
            last = p
    while n - last > MOST:
        last += MOST
        ends.append(last)
    return ends if last == n else [*ends, n]


def chunks_of(data: bytes) -> list[bytes]:
    ends = cut_places(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _media(batches):
    """(id, n_bytes, media digest, chunks) of each row, in small slices."""
    for batch in batches:
        for first in range(0, batch.num_rows, 128):
            part = batch.slice(first, 128)
            rows = []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                media = wav(payload_of(raw))
                rows.append((key, len(raw), hashlib.sha256(media).digest(), chunks_of(media)))
            yield rows


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, medium (its digest) and the ordered digests of its chunks."""

    def run(batches):
        for rows in _media(batches):
            digests = [[hashlib.sha256(c).digest() for c in r[3]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array(digests, pa.list_(pa.binary()))],
                ["doc_id", "n_bytes", "medium", "digests"],
            )

    return docs.mapInArrow(run, "doc_id long, n_bytes long, medium binary, digests array<binary>")


def _key(digests: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], dtype=np.int64)


def write_store(docs: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stores all media. Returns ``whole`` (medium, chunks in order) and ``loose`` (digest, data), both read back."""
    often = listed.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bloom = bloom_of(often.select(F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("key")), "key")

    def run(batches):
        shared, seen = Bloom(bloom.value), set()
        for rows in _media(batches):
            out = []
            for _, _, medium, chunks in rows:
                digests = [hashlib.sha256(c).digest() for c in chunks]
                if not shared.might_contain(_key(digests)).any():
                    out.append((0, medium, b"".join(chunks), [len(c) for c in chunks]))
                    continue
                for d, c in zip(digests, chunks):
                    if d not in seen:
                        if len(seen) > 200_000:  # a forgotten chunk is only written again and dropped by the join
                            seen.clear()
                        seen.add(d)
                        out.append((1, d, c, [len(c)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.list_(pa.int64()))],
                ["loose", "name", "data", "sizes"],
            )

    spark = docs.sparkSession
    path = new_path(spark, "chunks")
    docs.mapInArrow(run, "loose int, name binary, data binary, sizes array<long>").write.partitionBy("loose").option("compression", "zstd").parquet(path)
    stored = spark.read.schema("name binary, data binary, sizes array<long>, loose int").parquet(path)
    whole = stored.filter("loose = 0").select(F.col("name").alias("medium"), "data", "sizes")
    loose = materialise(stored.filter("loose = 1").select(F.col("name").alias("digest"), "data").dropDuplicates(["digest"]), "loose")
    return whole, loose


def feature(payload: bytes) -> str:
    """Mean, root mean square and sign changes of the centred samples."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def with_chunks(references: DataFrame, loose: DataFrame) -> DataFrame:
    """``references`` (medium, seq, digest) with the data of their chunks.

    A chunk that many media refer to is copied to several places, and its references are dealt to them. How many depends
    on the counter of the digest's hash, so both sides know it from one table of at most ``COUNTERS`` rows; digests that share
    a counter with a frequent one are copied in vain, which changes no result.
    """
    counter = F.pmod(F.xxhash64("digest"), F.lit(COUNTERS)).cast("int")
    counts = references.groupBy(counter.alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    mean = F.sum("n").over(Window.partitionBy()) / COUNTERS
    places = materialise(counts.select("counter", F.ceil(F.col("n") / F.greatest(F.lit(float(PER_PLACE)), 4 * mean)).cast("int").alias("places")).filter("places > 1"), "places")
    known = F.broadcast(places)  # at most COUNTERS rows of two integers
    several = F.coalesce("places", F.lit(1))
    dealt = references.withColumn("counter", counter).join(known, "counter", "left").withColumn("place", F.pmod(F.xxhash64("medium", "seq"), several).cast("int"))
    copied = loose.withColumn("counter", counter).join(known, "counter", "left").withColumn("place", F.explode(F.sequence(F.lit(0), several - 1)))
    return dealt.select("medium", "seq", "digest", "place").join(copied.select("digest", "place", "data"), ["digest", "place"]).select("medium", "seq", "digest", "data")


def read_store(listed: DataFrame, whole: DataFrame, loose: DataFrame) -> DataFrame:
    """Per medium: its verified bytes' digests and features. Rows hold a medium's chunks in order, each with its digest."""
    once = listed.select("medium", "digests").dropDuplicates(["medium"])
    spread = materialise(once.join(whole.select("medium"), "medium", "left_anti").select("medium", F.posexplode("digests").alias("seq", "digest")), "references")
    gathered = with_chunks(spread, loose).groupBy("medium").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "data"))).alias("parts"))
    shape = "medium binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"

    def described(rows):
        out = []
        for medium, media, n in rows:
            if hashlib.sha256(media).digest() != medium:
                raise ValueError(f"medium {medium.hex()} reads back otherwise")
            p = samples(media)
            out.append((medium, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), medium.hex(), feature(p), n))
        kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [f.split()[0] for f in shape.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    def from_whole(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 128):
                part = batch.slice(first, 128)
                yield described((m, d, len(s)) for m, d, s in zip(*(c.to_pylist() for c in part.columns)))

    def joined(medium, parts):
        for p in parts:
            if hashlib.sha256(p["data"]).digest() != p["digest"]:
                raise ValueError(f"chunk {p['digest'].hex()} reads back otherwise")
        return medium, b"".join(p["data"] for p in parts), len(parts)

    def from_parts(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                yield described(joined(m, p) for m, p in zip(*(c.to_pylist() for c in part.columns)))

    return whole.select("medium", "data", "sizes").mapInArrow(from_whole, shape).unionByName(gathered.mapInArrow(from_parts, shape))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a medium, reads all media back and describes them, one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    listed = materialise(manifest(rows), "manifest")
    whole, loose = write_store(rows, listed)
    return listed.select("doc_id", "n_bytes", "medium").join(read_store(listed, whole, loose), "medium").drop("medium")
