"""Shared helpers of the subpackage: reading tables, cutting lineage through
tables in the shared checkpoint folder, word and shingle hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import ensure_checkpoint_dir, ship_package


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and scan it back: lineage
    ends there, and a lost executor costs a re-read only."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_PER_BATCH = 2500           # texts are long: rows of an Arrow batch at most


def workers_ready(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, and keep the Arrow
    batches they get small (results do not depend on it)."""
    ship_package(spark)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= ROWS_PER_BATCH:
        spark.conf.set(size, str(ROWS_PER_BATCH))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_KEPT: dict[tuple, object] = {}


def kept_in_worker(name: tuple, make):
    """What a reused Python worker keeps for later tasks, of one operator at a
    time: asking for another's drops it."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def sliced(batches, rows: int = 512):
    """The batches of a task in slices, so that a worker holds few texts as
    Python objects at a time; nothing is kept from other operators."""
    _KEPT.clear()
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def crc_bucket(key: Column, buckets: int) -> Column:
    """crc32 of the key written as text, modulo ``buckets`` (0 for null)."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(buckets)), F.lit(0))


# --- word and shingle hashing (used inside Python tasks) -------------------

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of byte words, cached; the cache is emptied when full."""

    def __init__(self, limit: int = 100_000):
        import xxhash
        self._digest = xxhash.xxh64_intdigest
        self._limit = limit
        self._seen: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        seen = self._seen
        if len(seen) > self._limit:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = self._digest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def shingle_set(words: list[bytes], width: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; the whole
    sequence is the one shingle of a shorter text, no words give no shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = hasher(words)
    w = min(width, len(words))
    n = len(words) - w + 1
    acc = np.full(n, np.uint64(w), np.uint64)
    for j in range(w):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
    return np.unique(acc)


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z (UTF-8 bytes)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
