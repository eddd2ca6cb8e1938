"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of local sessions (tests) that name none.
_LOCAL: dict[str, str] = {}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir was given. Where neither is
    set, a temporary folder serves a local session; a cluster has none that all machines see."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _LOCAL.get(spark.sparkContext.applicationId) or _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="folioworks-"))
    return folder.rstrip("/")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, *partition_by: str, **options: object) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut and a lost executor costs nothing."""
    path = new_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_join(rows: DataFrame, looked_up: DataFrame, frequent: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to ``looked_up``, a table of distinct keys: keys of ``frequent``, a small table with a proven bound, are
    looked up in a broadcast, so that no task gets all rows of such a key; the rest is shuffled."""
    marked = rows.join(F.broadcast(frequent.select(key).withColumn("_frequent", F.lit(True))), key, "left")
    often = marked.filter("_frequent").join(F.broadcast(looked_up.join(frequent.select(key), key, "left_semi")), key, "left")
    return often.unionByName(marked.filter("_frequent is null").join(looked_up, key, "left")).drop("_frequent")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII text takes the quick built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def salt_count(rows: int, per_group: int) -> int:
    return max(1, -(-rows // per_group))


BLOOM_BITS = 1 << 24
BLOOM_HASHES = 4


class Bloom:
    """A fixed-size membership filter over long keys; it may say yes wrongly, never no wrongly."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def positions(keys: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            a = mix64(keys.astype(np.int64).view(np.uint64))
            b = mix64(a) | np.uint64(1)
            return [(a + np.uint64(i) * b) & np.uint64(BLOOM_BITS - 1) for i in range(BLOOM_HASHES)]

    def might_contain(self, keys: np.ndarray) -> np.ndarray:
        hits = (
            (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) for p in self.positions(keys)
        )
        return reduce(np.bitwise_and, hits).astype(bool)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bloom_of(df: DataFrame, key: str):
    """Broadcasts a Bloom filter of a long column: 2 MB whatever the number of keys, built by a distributed bit_or.

    With more keys than it can tell apart it lets rows through that a later join drops; results stay the same.
    """

    def bits(batches):
        words = np.zeros(BLOOM_BITS // 64, dtype=np.uint64)
        for batch in batches:
            keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            for p in Bloom.positions(keys):
                np.bitwise_or.at(words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(words)
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["word", "bits"])

    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long")).mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(BLOOM_BITS // 64, dtype=np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(words)
