"""Document fingerprints: bottom-k sketches of shingle hashes (operator 8).

A text's shingles are its 5-word sequences (words lower-cased, split at white
space); a shorter text has one shingle, its whole word sequence, and a text
without words none.  The sketch is the sorted array of the ``K`` smallest
distinct 64-bit shingle hashes.  Sketches merge by union (also across parts
of a corpus), and give estimates of resemblance, containment and the number
of distinct shingles; texts with fewer than ``K`` distinct shingles, whose
sketches are whole sets, are compared exactly.

Built from DataFrame functions throughout.

Defined results: null text counts as empty; the sketch of a text without
words is empty, and two empty sketches have resemblance 1; repeated rows
(same id and text) count as one document in the order of documents and get
the same result; null ids come first (the least 64-bit id counts as null); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, shared_table

K = 128
WIDTH = 5


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_sketches(df: DataFrame, texts: dict[str, str], k: int = K, width: int = WIDTH) -> DataFrame:
    """``df`` with a sketch column for each (new column -> text column)."""
    hashed = df.withColumns({f"_{n}_h": F.transform(words(F.coalesce(t, F.lit(""))), lambda w: F.xxhash64(w))
                             for n, t in texts.items()})

    def sketch(h: str) -> Column:
        c = F.col(h)
        runs = F.transform(F.sequence(F.lit(1), F.size(c) - (width - 1)),
                           lambda i: F.xxhash64(*[F.element_at(c, i + j) for j in range(width)]))
        whole = F.array(F.xxhash64(F.array_join(c.cast("array<string>"), " ")))
        sh = (F.when(F.size(c) >= width, runs).when(F.size(c) > 0, whole)
              .otherwise(F.array().cast("array<bigint>")))
        return F.slice(F.sort_array(F.array_distinct(sh)), 1, k)

    return hashed.withColumns({n: sketch(f"_{n}_h") for n in texts}).drop(*[f"_{n}_h" for n in texts])


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets behind two sketches;
    exact when both hold fewer than ``k`` hashes."""
    every = F.array_union(a, b)
    low = F.when((F.size(a) < k) & (F.size(b) < k), every).otherwise(F.slice(F.sort_array(every), 1, k))
    both = F.array_intersect(F.array_intersect(a, b), low)
    return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(low))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (exact up to ``k - 1``)."""
    share = (F.element_at(a, -1).cast("double") + float(2 ** 63)) / float(2 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has."""
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (n + m) / ((j + 1) * n)))


def printed(a: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def merge_sketches(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K,
                   salts: int = 64) -> DataFrame:
    """One sketch per group from the sketches of its parts.

    Hashes are spread over ``salts`` parts of a group, each part keeps its
    ``k`` smallest, and the last step sees at most ``salts * k`` of them.
    """
    each = (df.select(*keys, F.explode(sketch).alias("_h"))
            .withColumn("_s", F.pmod("_h", F.lit(salts))).distinct())
    part = Window.partitionBy(*keys, "_s").orderBy("_h")
    least = each.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k)
    last = Window.partitionBy(*keys).orderBy("_h")
    return (least.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= k)
            .groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch)))   # at most k


def next_documents(ids: DataFrame) -> DataFrame:
    """(key, h, n) rows with the row after each in ascending (key, h)
    order as ``next_key, next_h``; after the last comes the first.

    The order comes from range partitions, written so that they stay the
    same; only one row of each partition is looked at across partitions.
    """
    spark = ids.sparkSession
    ranged = shared_table(ids.repartitionByRange(partitions(spark), "key", "h")
                          .withColumn("part", F.spark_partition_id()), "doc-order")
    me = F.struct("key", "h")
    heads = ranged.groupBy("part").agg(F.min(me).alias("head"))
    over = Window.orderBy("part")                       # one row for each partition
    first = F.first("head").over(over)
    heads = heads.select("part", F.coalesce(F.lead("head").over(over), first).alias("after"))
    within = F.lead(me).over(Window.partitionBy("part").orderBy("key", "h"))
    return (ranged.withColumn("within", within).join(F.broadcast(heads), "part")
            .withColumn("nxt", F.coalesce("within", "after"))
            .select("key", "h", "n", F.col("nxt.key").alias("next_key"), F.col("nxt.h").alias("next_h")))


def edited_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """Every document with its sketch, that of its edited text (last quarter
    replaced by as many first characters of the next document) and the next
    document's."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # (key, h) names a document: its id, the least 64-bit number for null, and a hash
    null = F.lit(-2 ** 63).cast("bigint")
    base = base.select(F.coalesce(F.col("doc_id").cast("bigint"), null).alias("key"),
                       F.xxhash64("text").alias("h"), "text")
    ids = base.select("key", "h", F.length("text").alias("n")).distinct()
    order = shared_table(next_documents(ids), "doc-next")
    lender = order.select(F.col("next_key").alias("key"), F.col("next_h").alias("h"), F.col("key").alias("to_key"),
                          F.col("h").alias("to_h"), F.expr("n div 4").cast("int").alias("take"))
    # both joins read the same exchange of the texts by (key, h)
    given = with_sketches(base.join(lender, ["key", "h"]), {"next_sketch": F.col("text")}, k)
    given = given.select(F.col("to_key").alias("key"), F.col("to_h").alias("h"),
                         F.expr("substring(text, 1, take)").alias("lent"), "next_sketch").dropDuplicates(["key", "h"])
    pairs = base.join(given, ["key", "h"]).withColumn("n", F.length("text"))
    pairs = pairs.select(F.nullif("key", null).alias("doc_id"), "text", F.col("n").cast("long").alias("n_chars"), "next_sketch",
                         F.concat(F.expr("substring(text, 1, n - n div 4)"), F.col("lent")).alias("edited"))
    return with_sketches(pairs, {"sketch": F.col("text"), "edited_sketch": F.col("edited")}, k)


def digest(pairs: DataFrame, k: int = K) -> DataFrame:
    """Printed fingerprints and the likenesses of :func:`edited_pairs`."""
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"), printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
