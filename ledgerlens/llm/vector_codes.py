"""Product codes of vectors by Lloyd rounds on two trees (operator 12).

A vector of numbers becomes whole numbers floor(256 x), is cut into ``PARTS``
consecutive parts of equal width, and every part is replaced by the index of
the nearest of ``ENTRIES`` codebook entries of its position.  Codebooks begin
as the parts of the vectors with the smallest ids and are moved by ``ROUNDS``
Lloyd rounds; all arithmetic is on whole numbers, so the result is the same
however rows are dealt to tasks.

Method: dual-tree Lloyd.  In each batch and position a tree over the parts
(boxes halved at the median of their widest side, with counts and sums) meets
a tree over the entries.  Pairs of nodes go down both trees together; a pair
is dropped where the least distance between its boxes exceeds the greatest
distance of another pair of the same part node.  A part node left with one
entry is assigned as a whole by its cached count and sum; what is undecided in
the leaves is settled by integer distances, ties to the lower index.

Tasks return sums per position and entry, so a round sends codebook-sized
tables only: PARTS x ENTRIES rows of the part's width, whatever the number of
rows.

Defined results: vectors that are null or hold a null, NaN or infinite
component are dropped; shorter vectors are filled up with zeros to the longest
one, and that to a multiple of ``PARTS``; scaled components are held within
+-2^20; ids repeat or are null as they like: every row is encoded, each
distinct id seeds one entry (its least vector), a null id comes last; fewer
ids than ``ENTRIES`` give shorter codebooks; rows without label are one group;
an empty table gives an empty result; further columns pass through
untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_table, workers_ready

PARTS = 16
ENTRIES = 64
ROUNDS = 2
LEAF = 16                       # parts in a leaf at most
BATCH_ROWS = 16_384             # rows of a pair of trees at most
LIMIT = 1 << 20
BROADCAST_LABELS = 1_000_000    # label totals broadcast at most
SALTS = 64


# --- two trees (inside tasks) ----------------------------------------------

class BoxTree:
    """Boxes, counts and sums over rows of whole numbers, halved by rank along
    the widest side; node ``i`` of a level has children ``2i``, ``2i + 1``."""

    def __init__(self, rows: np.ndarray, leaf: int):
        n = len(rows)
        self.order, self.levels = np.arange(n), []
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        for level in range(depth + 1):
            bounds = (np.arange((1 << level) + 1) * n) >> level
            x = rows[self.order]
            low, high = (f.reduceat(x, bounds[:-1], axis=0) for f in (np.minimum, np.maximum))
            self.levels.append((bounds, low, high, np.add.reduceat(x, bounds[:-1], axis=0)))
            if level < depth:
                node = np.repeat(np.arange(1 << level), np.diff(bounds))
                side = np.argmax(high - low, axis=1)[node] if rows.shape[1] else np.zeros(n, int)
                key = x[np.arange(n), side] if rows.shape[1] else np.zeros(n, int)
                self.order = self.order[np.lexsort((key, node))]


def _drop_far(p: np.ndarray, e: np.ndarray, parts: tuple, entries: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The node pairs that may hold a nearest entry; ``p`` is sorted."""
    (_, plow, phigh, _), (_, elow, ehigh, _) = parts, entries
    gap = np.maximum(np.maximum(elow[e] - phigh[p], plow[p] - ehigh[e]), 0)
    far = np.maximum(ehigh[e] - plow[p], phigh[p] - elow[e])
    least, most = (gap * gap).sum(axis=1), (far * far).sum(axis=1)
    heads = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    bound = np.repeat(np.minimum.reduceat(most, heads), np.diff(np.r_[heads, len(p)]))
    keep = least <= bound
    return p[keep], e[keep]


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry of every row, with the entries' counts and
    sums of rows (int64 all)."""
    n, k = len(rows), len(book)
    label, counts, sums = np.zeros(n, np.int64), np.zeros(k, np.int64), np.zeros(book.shape, np.int64)
    if not n:
        return label, counts, sums
    filled = np.vstack([book, np.repeat(book[-1:], (1 << (k - 1).bit_length()) - k, axis=0)])     # leaves of one entry
    parts, entries = BoxTree(rows, LEAF), BoxTree(filled, 1)
    entries.order = np.minimum(entries.order, k - 1)
    p, e, level, entry_level = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    while True:
        if entry_level + 1 < len(entries.levels):               # down the entries' tree
            entry_level += 1
            p, e = np.repeat(p, 2), np.repeat(2 * e, 2) + np.tile([0, 1], len(e))
        p, e = _drop_far(p, e, parts.levels[level], entries.levels[entry_level])
        if entry_level + 1 == len(entries.levels):              # whole nodes with one entry left
            bounds, _, _, total = parts.levels[level]
            left = np.diff(np.flatnonzero(np.r_[True, p[1:] != p[:-1], True]))
            single = np.repeat(left == 1, left)
            node, found = p[single], entries.order[e[single]]
            size = bounds[node + 1] - bounds[node]
            np.add.at(counts, found, size)
            np.add.at(sums, found, total[node])
            at = np.repeat(bounds[node] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            label[parts.order[at]] = np.repeat(found, size)
            p, e = p[~single], e[~single]
            if not len(p) or level + 1 == len(parts.levels):
                break
        if level + 1 < len(parts.levels):                       # down the parts' tree
            level += 1
            halves = np.repeat(p, 2) * 2 + np.tile([0, 1], len(p))
            by = np.argsort(halves, kind="stable")
            p, e = halves[by], np.repeat(e, 2)[by]
    if len(p):                                                  # undecided leaves
        bounds = parts.levels[-1][0]
        size = bounds[p + 1] - bounds[p]
        at = np.repeat(bounds[p] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        entry = np.repeat(entries.order[e], size)
        row = parts.order[at]
        off = rows[row] - book[entry]
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, row, (off * off).sum(axis=1) * k + entry)
        row = np.unique(row)
        label[row] = best[row] % k
        counts += np.bincount(label[row], minlength=k)
        np.add.at(sums, label[row], rows[row])
    return label, counts, sums


def _batches(batches):
    """(batch, vectors as an int64 matrix) of bounded size."""
    for b in batches:
        for lo in range(0, b.num_rows, BATCH_ROWS):
            s = b.slice(lo, BATCH_ROWS)
            v = s.column("q")
            yield s, v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(s.num_rows, -1)


def _summing(books: np.ndarray):
    """Arrow task: sums of the rows nearest to each entry, once a task."""
    def run(batches):
        import pyarrow as pa
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for _, q in _batches(batches):
            for i, book in enumerate(books):
                w = book.shape[1]
                _, c, s = nearest(q[:, i * w:(i + 1) * w], book)
                counts[i] += c
                sums[i] += s
        if counts.any():
            part, entry, place = (x.ravel() for x in np.indices(books.shape))
            many = np.broadcast_to(counts[:, :, None], books.shape).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()),
                                              pa.array(many), pa.array(sums.ravel())], ["part", "entry", "place", "n", "total"])
    return run


def _coding(books: np.ndarray):
    """Arrow task: rows with their code and error."""
    def run(batches):
        import pyarrow as pa
        for b, q in _batches(batches):
            codes, error = np.zeros((len(q), len(books)), np.uint8), np.zeros(len(q), np.int64)
            for i, book in enumerate(books):
                w = book.shape[1]
                x = q[:, i * w:(i + 1) * w]
                codes[:, i] = found = nearest(x, book)[0]
                error += ((x - book[found]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in b.schema.names if c != "q"],
                 pa.array([bytes(c).hex() for c in codes], pa.string()), pa.array(error)],
                [*[c for c in b.schema.names if c != "q"], "code", "error"])
    return run


# --- rounds ----------------------------------------------------------------

def whole_numbers(vectors: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """(id, q, row): kept vectors as whole numbers of one length, the carried
    columns of the input (all by default) in a struct."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(v, lambda x: F.least(F.greatest(F.floor(x.cast("double") * 256), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    kept = shared_table(vectors.where(fine).select(F.col("vec_id").alias("id"), q.alias("q"), F.struct(*(carried or ["*"])).alias("row")), "codes-vectors")
    low, high = kept.agg(F.min(F.size("q")), F.max(F.size("q"))).first()
    width = -(-(high or 0) // PARTS) * PARTS
    if low is not None and low < width:
        kept = kept.withColumn("q", F.concat("q", F.array_repeat(F.lit(0), F.lit(width) - F.size("q"))))
    return kept


def first_books(kept: DataFrame) -> np.ndarray:
    """Codebooks (position, entry, place) from the vectors of the least ids."""
    ids = kept.select("id").distinct().orderBy(F.asc_nulls_last("id")).limit(ENTRIES)
    ids = F.broadcast(ids.withColumnRenamed("id", "_id"))                     # ENTRIES rows
    seeds = kept.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").groupBy("id").agg(F.min("q").alias("q"))
    rows = [r["q"] for r in seeds.orderBy(F.asc_nulls_last("id")).collect()]  # ENTRIES rows at most
    m = np.array(rows, np.int64).reshape(len(rows), PARTS, -1) if rows else np.zeros((0, PARTS, 0), np.int64)
    return np.ascontiguousarray(m.transpose(1, 0, 2))


def moved_books(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """One Lloyd round: entries moved to floor(sum / count) of their parts."""
    sums = (kept.select("q").mapInArrow(_summing(books), "part int, entry int, place int, n long, total long")
            .groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    books = books.copy()
    for r in sums.where("n > 0").collect():                                   # one row a codebook component
        books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def fit(kept: DataFrame) -> np.ndarray:
    """Final codebooks of :func:`whole_numbers`' rows."""
    workers_ready(kept.sparkSession)
    books = first_books(kept)
    for _ in range(ROUNDS if books.size else 0):
        books = moved_books(kept, books)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(row, code, error) of every kept vector."""
    workers_ready(kept.sparkSession)
    schema = kept.select("row").schema.add("code", "string").add("error", "long")
    return kept.select("row", "q").mapInArrow(_coding(books), schema)


def said(books: np.ndarray) -> str:
    """Digest of all entries' components by position, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_totals(coded: DataFrame, spark: SparkSession) -> DataFrame:
    """``label_error``: the errors summed over equal labels, nulls together."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    totals = shared_table(totals, "codes-labels")
    same = F.col("label").eqNullSafe(F.col("_label"))
    if totals.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(totals), same).drop("_label")
    # many labels: a frequent one is spread over salts
    salted = coded.withColumn("_s", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    totals = totals.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(totals, same & (F.col("_s") == F.col("_t"))).drop("_label", "_s", "_t")


def digest(vectors: DataFrame) -> DataFrame:
    """One row a kept vector: its code, errors and the codebooks' digest."""
    kept = whole_numbers(vectors, ["vec_id", "label"])
    books = fit(kept)
    coded = shared_table(encode(kept, books).select("row.vec_id", "row.label", "code", "error"), "codes-coded")
    return (with_label_totals(coded, vectors.sparkSession)
            .select("vec_id", "code", "error", "label_error", F.lit(said(books)).alias("codebooks_sha256")))
