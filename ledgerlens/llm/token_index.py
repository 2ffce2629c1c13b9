"""Token-id output with a minimal perfect hash index (operator 4).

Format: a folder with four parquet tables, written and read by Spark in any
file system it knows.

* ``payload``: one file a shard, one row per block of consecutive documents of
  it, in ascending document order: ``shard``, ``block``, ``before`` (ids of
  the shard before the block), ``lengths`` (ids of each document), ``offsets``
  (ids before it in the block), ``ids`` (raw little-endian ids: unsigned
  16-bit when the vocabulary fits, else 32-bit) and ``keys`` (read only to
  build the index and to see which documents have one).  Row groups hold few
  blocks, so that a reader that wants one block reads little else.
* ``shards``: one row a shard: ids of all shards before it, name of its file.
* ``index``: one row per bucket of keys: a minimal perfect hash function in
  levels of bit arrays with sampled ranks, and by slot a 32-bit fingerprint of
  the key, the number of its documents, and where the first one is: shard,
  block, place in the block, offset of its first id within the shard, number
  of its ids, and how many of the key's documents the block holds from there.
* ``runs``: where the further documents are of keys that go on in later blocks.

A lookup hashes the key to its bucket, walks the levels (1.6 probes on
average, bounded by the number of levels), takes the rank of the bit (nearest
sample and at most ``RANK_BITS`` bits) as its slot and compares the
fingerprint: constant time however large the table is.  :func:`fetch` reads
the ids of some keys from their blocks alone.

Defined results: null text counts as empty (end id only); rows with a null
key come first and are in no slot, and read back with a null key; rows that
repeat a key follow each other (ordered by a hash of the text) and share a
slot that counts them; a stored key that the index does not hold raises; keys
asked for that are not stored give no row; an empty table gives empty tables.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix64, partitions, shared_table, sliced, workers_ready
from .tokens import encoder, vocabulary_path

BUCKET_KEYS = 20_000            # expected keys of an index bucket
BLOCK_BYTES = 1 << 20           # ids of a payload block, about
BLOCK_DOCS = 50_000             # documents of a payload block at most
BLOCK_CHARS = 8_000_000         # characters encoded at a time
UNITS_KEPT = 500_000            # cached units of a worker
GAMMA = 2.0                     # bits per key on each level
GROUP_BYTES = 4 << 20           # bytes of a row group, about
RANK_BITS = 512                 # bits between two sampled ranks
ASKED_AT_ONCE = 100_000         # keys whose places are broadcast at most
LISTED = 5_000                  # buckets, files and blocks named in a filter at most
PAYLOAD = ("shard int, block int, before bigint, keys array<bigint>, lengths array<int>, offsets array<bigint>, "
           "ids binary")
SLOT_COLUMNS = {"copies": "bigint", "shard": "int", "block": "int", "pos": "int", "start": "bigint",
                "n_tokens": "bigint", "run": "bigint"}
INDEX = ("bucket bigint, levels array<bigint>, bits binary, ranks array<bigint>, fp array<bigint>, "
         + ", ".join(f"{c} array<{t}>" for c, t in SLOT_COLUMNS.items()))
RUNS = "key bigint, shard int, block int, pos int, run bigint"
SHARDS = "shard int, first bigint, file string"


# --- minimal perfect hashing of one bucket ---------------------------------

def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix64(keys + np.uint64((level * 0x9E3779B97F4A7C15 + 0x51ED27) % 2 ** 64))


def mphf_build(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Level sizes and concatenated bits for distinct 64-bit keys: a key's bit
    on a level is set when no other remaining key hashes there."""
    sizes, bits = [], []
    left, level = keys, 0
    while len(left):
        size = max(64, int(GAMMA * len(left)))
        at = (_level_hash(left, level) % np.uint64(size)).astype(np.int64)
        once = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(once)
        left, level = left[~once[at]], level + 1
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def _walk(keys: np.ndarray, sizes: list[int], is_set, rank) -> np.ndarray:
    """Slot of each key, or -1 when no level holds it."""
    slots, base = np.full(len(keys), -1, np.int64), 0
    left = np.arange(len(keys))
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = base + (_level_hash(keys[left], level) % np.uint64(size)).astype(np.int64)
        held = is_set(at)
        slots[left[held]] = rank(at[held])
        left, base = left[~held], base + size
    return slots


def mphf_slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slots by the bits themselves, as known while building."""
    ranks = np.cumsum(bits) - 1
    return _walk(keys, sizes, bits.__getitem__, ranks.__getitem__)


def pack_bits(bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits as stored, with the number of set ones before every
    ``RANK_BITS`` of them."""
    whole = np.zeros(-(-len(bits) // RANK_BITS) * RANK_BITS, bool)
    whole[:len(bits)] = bits
    ones = whole.reshape(-1, RANK_BITS).sum(axis=1)
    return np.packbits(whole, bitorder="little").tobytes(), np.cumsum(ones) - ones


def stored_slots(keys: np.ndarray, sizes: list[int], packed: bytes, ranks: np.ndarray) -> np.ndarray:
    """Slots by stored bits: a rank counts from the sample before it."""
    words = np.frombuffer(packed, "<u8")
    group = RANK_BITS // 64

    def is_set(at):
        return (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(at):
        word, first = at >> 6, at // RANK_BITS
        found = ranks[first] + np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
        for i in range(group - 1):
            before = first * group + i
            found = found + np.where(before < word, np.bitwise_count(words[before]), 0)
        return found

    return _walk(keys, sizes, is_set, rank)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.int64)


def key_bits(keys) -> np.ndarray:
    return mix64(np.asarray(keys, np.int64).view(np.uint64))


# --- writing ---------------------------------------------------------------

def write_payload(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode and write documents in ascending (doc_id, hash of text) order.

    Texts are dealt to shards by ranges and sorted there, and encoded by the
    same task that writes, so ids are never shuffled."""
    spark = docs.sparkSession
    workers_ready(spark)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    ranged = (base.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h")
              .withColumn("shard", F.spark_partition_id()).select("shard", "doc_id", "text"))

    def encode(batches):
        enc = encoder(tokenizer, BLOCK_CHARS, UNITS_KEPT)
        dtype = "<u2" if enc.tok.get_vocab_size() <= 65536 and end_id < 65536 else "<u4"
        end = np.array([end_id], "<u4").tobytes()
        state = {"block": 0, "before": 0}

        def row(shard, keys, lengths, parts):
            block, before = state["block"], state["before"]
            state.update(block=block + 1, before=before + sum(lengths))
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                "before": pa.array([before], pa.int64()),
                "keys": pa.array([keys], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int32())),
                "offsets": pa.array([np.cumsum([0] + lengths[:-1])], pa.list_(pa.int64())),
                "ids": pa.array([np.frombuffer(b"".join(parts), "<u4").astype(dtype).tobytes()], pa.binary())})

        keys, lengths, parts, held, shard = [], [], [], 0, None
        for b in batches:
            made = enc.encode(b.column("text"))
            for shard, key, ids in zip(b.column("shard").to_pylist(), b.column("doc_id").to_pylist(), made):
                ids += end
                keys.append(key)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids)
                if held >= 2 * BLOCK_BYTES or len(keys) >= BLOCK_DOCS:
                    yield row(shard, keys, lengths, parts)
                    keys, lengths, parts, held = [], [], [], 0
        if keys:
            yield row(shard, keys, lengths, parts)

    # raw ids hardly compress; the writer looks at a row group's size after every block
    (ranged.mapInArrow(encode, PAYLOAD).write.option("compression", "none").option("parquet.block.size", GROUP_BYTES)
     .option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1).parquet(f"{path}/payload"))


def _blocks(spark: SparkSession, path: str, *cols: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).parquet(f"{path}/payload").select("shard", "block", *cols)


def write_shards(spark: SparkSession, path: str) -> None:
    """Ids before each shard and its file's name, over the lengths only."""
    ids = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    shards = _blocks(spark, path, ids.alias("t"), F.col("_metadata.file_name").alias("file")).groupBy("shard", "file").agg(
        F.sum("t").alias("t"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)    # one row a shard
    (shards.select("shard", F.coalesce(F.sum("t").over(earlier), F.lit(0).cast("long")).alias("first"), "file")
     .write.parquet(f"{path}/shards"))


def write_runs(spark: SparkSession, path: str) -> None:
    """Places of keys in blocks after their first.  Equal keys follow each
    other, so only the first and the last key of a block can go on in others:
    one or two rows a block are grouped."""
    n = F.size("keys")
    of = lambda k: F.size(F.filter("keys", lambda x: x == k)).cast("long")          # noqa: E731
    low, high = F.element_at("keys", 1), F.element_at("keys", -1)
    ends = (_blocks(spark, path, "keys").select("shard", "block", F.explode(F.array_distinct(F.array(
        F.struct(low.alias("key"), F.lit(0).alias("pos"), of(low).alias("run")),
        F.struct(high.alias("key"), (n - of(high)).cast("int").alias("pos"), of(high).alias("run"))))).alias("e"))
        .select("e.key", "shard", "block", "e.pos", "e.run").where("key IS NOT NULL"))
    place = F.struct("shard", "block")
    firsts = ends.groupBy("key").agg(F.min(place).alias("f"), F.count("*").alias("c")).where("c > 1").select("key", "f")
    ends.join(firsts, "key").where(place > F.col("f")).select("key", "shard", "block", "pos", "run").write.parquet(f"{path}/runs")


def write_index(spark: SparkSession, path: str, bucket_keys: int = BUCKET_KEYS) -> None:
    """Build the index from the keys and lengths of the payload."""
    workers_ready(spark)
    write_shards(spark, path)
    write_runs(spark, path)
    rows = (_blocks(spark, path, "before", F.size("keys").alias("size"), F.posexplode(F.arrays_zip("keys", "lengths", "offsets")))
            .select("shard", "block", "pos", (F.col("before") + F.col("col.offsets")).alias("start"),
                    F.col("col.lengths").cast("long").alias("n_tokens"), (F.col("size") - F.col("pos")).alias("room"),
                    F.col("col.keys").alias("key")))
    keys = (rows.where(F.col("key").isNotNull()).groupBy("key")
            .agg(F.min(F.struct("shard", "block", "pos", "start", "n_tokens", "room")).alias("f"),
                 F.count("*").alias("copies")).select("key", "copies", "f.*")
            .withColumn("run", F.least("copies", F.col("room").cast("long"))).drop("room"))
    n = _blocks(spark, path, "lengths").agg(F.sum(F.size("lengths")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-n // bucket_keys))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = key_bits(pdf["key"].to_numpy())
        sizes, held = mphf_build(bits)
        slot = mphf_slots(bits, sizes, held)
        packed, ranks = pack_bits(held)
        pdf = pdf.assign(fp=fingerprint(bits)).iloc[np.argsort(slot)]
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "levels": [sizes], "bits": [packed], "ranks": [ranks],
                             **{c: [pdf[c].to_numpy()] for c in ("fp", *SLOT_COLUMNS)}})

    (keys.withColumn("bucket", bucket_of(F.col("key"), buckets)).groupBy("bucket")
     .applyInPandas(build, INDEX).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/index"))


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Write ``docs`` (doc_id, text) in the format described above."""
    write_payload(docs, path, tokenizer or vocabulary_path(), end_id)
    write_index(docs.sparkSession, path)


# --- reading ---------------------------------------------------------------

def lookup(keys: DataFrame, path: str, few: bool | None = None) -> DataFrame:
    """(key, copies, shard, block, pos, start, n_tokens, run) of the keys that
    the index holds: hash, level walk, slot, fingerprint.  Where ``few`` keys
    are asked for (counted if not said), only their buckets are read."""
    spark = keys.sparkSession
    workers_ready(spark)
    index = spark.read.schema(f"{INDEX}, buckets int").parquet(f"{path}/index")
    head = index.select("buckets").head()
    buckets = head["buckets"] if head else 1
    asked = keys.select(F.col(keys.columns[0]).cast("bigint").alias("key")).where("key IS NOT NULL").distinct()
    asked = asked.withColumn("bucket", bucket_of(F.col("key"), buckets))
    if few is not False:
        named = [r["bucket"] for r in asked.select("bucket").distinct().limit(LISTED + 1).collect()]
        if len(named) <= LISTED:
            index = index.where(F.col("bucket").isin(named))
    schema = "key bigint, " + ", ".join(f"{c} {t}" for c, t in SLOT_COLUMNS.items())

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ["key", *SLOT_COLUMNS]})
        r = right.iloc[0]
        bits = key_bits(left["key"].to_numpy())
        slot = stored_slots(bits, [int(x) for x in r["levels"]], r["bits"], np.asarray(r["ranks"]))
        ok = slot >= 0
        ok[ok] = np.asarray(r["fp"])[slot[ok]] == fingerprint(bits[ok])
        return pd.DataFrame({"key": left["key"].to_numpy()[ok], **{c: np.asarray(r[c])[slot[ok]] for c in SLOT_COLUMNS}})

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(probe, schema)


def places(keys: DataFrame, path: str, few: bool | None = None) -> DataFrame:
    """(key, shard, block, pos, run): every block that holds documents of
    these keys, from ``pos`` on ``run`` of them."""
    spark = keys.sparkSession
    found, more = lookup(keys, path, few), spark.read.schema(RUNS).parquet(f"{path}/runs")
    cols = ["key", "shard", "block", "pos", "run"]
    if more.isEmpty():
        return found.select(*cols)
    found = shared_table(found, "found")
    return found.select(*cols).union(more.join(found.where("copies > run").select("key"), "key").select(*cols))


def _ids(raw: bytes, lengths) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * sum(lengths) else "<u4").astype("<u4")


def fetch(keys: DataFrame, path: str) -> DataFrame:
    """(key, start, n_tokens, ids) of the stored documents of some keys (first
    column of ``keys``), ids as raw unsigned 32-bit little-endian numbers.

    Few keys are sent to their blocks: only files and row groups that hold one
    of them are read.  With more keys than ``ASKED_AT_ONCE`` blocks and places
    meet in a shuffle."""
    spark = keys.sparkSession
    asked = shared_table(places(keys, path), "places")
    wants = asked.groupBy("shard", "block").agg(F.collect_list(F.struct("key", "pos", "run")).alias("wants"))
    files = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    few = asked.count() <= ASKED_AT_ONCE
    blocks = None
    if few:
        named = files.join(asked.select("shard").distinct(), "shard", "left_semi").select("file").limit(LISTED + 1).collect()
        numbers = [r["block"] for r in asked.select("block").distinct().limit(LISTED + 1).collect()]
        if 0 < len(named) <= LISTED:
            blocks = spark.read.schema(PAYLOAD).parquet(*(f"{path}/payload/{r['file']}" for r in named))
            if len(numbers) <= LISTED:
                blocks = blocks.where(F.col("block").isin(numbers))
        wants = F.broadcast(wants)
    if blocks is None:
        blocks = spark.read.schema(PAYLOAD).parquet(f"{path}/payload")
    both = (blocks.select("shard", "block", "before", "lengths", "offsets", "ids").join(wants, ["shard", "block"])
            .join(F.broadcast(files), "shard")                                      # one row a shard
            .select((F.col("first") + F.col("before")).alias("at"), "lengths", "offsets", "ids", "wants"))

    def cut(batches):
        for b in sliced(batches, 8):
            out = {"key": [], "start": [], "n_tokens": [], "ids": []}
            for at, lengths, offsets, raw, wanted in zip(*(b.column(c).to_pylist() for c in
                                                           ("at", "lengths", "offsets", "ids", "wants"))):
                ids = _ids(raw, lengths)
                for w in wanted:
                    for i in range(w["pos"], w["pos"] + w["run"]):
                        out["key"].append(w["key"])
                        out["start"].append(at + offsets[i])
                        out["n_tokens"].append(lengths[i])
                        out["ids"].append(ids[offsets[i]:offsets[i] + lengths[i]].tobytes())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})

    return both.mapInArrow(cut, "key bigint, start bigint, n_tokens bigint, ids binary")


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, pos, keyed, start, n_tokens, ids_crc32) of every
    document, from the raw ids in blocks; the crc is over ids as unsigned
    32-bit little-endian."""
    workers_ready(spark)

    def cut(batches):
        for b in batches:
            out = {c: [] for c in ("shard", "block", "pos", "keyed", "start", "n_tokens", "ids_crc32")}
            for shard, block, at, keys, lengths, raw in zip(*(b.column(c).to_pylist() for c in
                                                              ("shard", "block", "at", "keys", "lengths", "ids"))):
                ids, n = _ids(raw, lengths), len(lengths)
                ends = np.cumsum(lengths).tolist()
                starts = [0, *ends[:-1]]
                out["shard"] += [shard] * n
                out["block"] += [block] * n
                out["pos"] += range(n)
                out["keyed"] += [k is not None for k in keys]
                out["start"] += [at + lo for lo in starts]
                out["n_tokens"] += lengths
                out["ids_crc32"] += [zlib.crc32(ids[lo:hi]) for lo, hi in zip(starts, ends)]
            kinds = {"keyed": pa.bool_(), "shard": pa.int32(), "block": pa.int32(), "pos": pa.int32()}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    files = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    return (_blocks(spark, path, "before", "keys", "lengths", "ids").join(F.broadcast(files), "shard")     # one row a shard
            .select("shard", "block", (F.col("first") + F.col("before")).alias("at"), "keys", "lengths", "ids").mapInArrow(
                cut, "shard int, block int, pos int, keyed boolean, start bigint, n_tokens bigint, ids_crc32 bigint"))


def read_all(docs: DataFrame, path: str) -> DataFrame:
    """Every stored document with its key, found by the place that the index
    names.  All blocks are wanted, so none is skipped, and only places and
    digests are shuffled, not ids; a stored key without a slot raises."""
    named = places(docs.select("doc_id"), path, few=False).select(
        F.col("key").alias("doc_id"), "shard", "block",
        F.explode(F.sequence("pos", (F.col("pos") + F.col("run") - 1).cast("int"))).alias("pos"))
    stored = read_payload(docs.sparkSession, path)
    lost = F.col("keyed") & F.col("doc_id").isNull()
    return stored.join(named, ["shard", "block", "pos"], "left").select(
        F.when(lost, F.raise_error(F.lit("a stored key is not in the index")).cast("bigint")).otherwise(F.col("doc_id")).alias("doc_id"),
        "start", "n_tokens", "ids_crc32")
