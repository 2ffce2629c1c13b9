"""Exact top-k search over binary codes by incremental multi-index hashing
(operator 6).

A vector's code has one bit per dimension, set where the value is positive,
kept in segments of ``SEGMENT`` bits.  The index posts every distinct code
under each of its (segment, value) pairs.  Round r joins the values at
distance exactly r from a query's segments; after it every code within
``segments * (r + 1) - 1`` bits has been met, so a query is finished once its
kth verified distance is no larger.  Only unfinished queries take part in the
next round.  A code met through several segments is verified once, at its
first segment of least distance.

Equal codes are held once with their ``k + 1`` smallest ids, which is all
that k neighbours can need, so groups of copies do not multiply.

Defined results: rows whose id or vector is null, or whose vector is empty,
are neither indexed nor asked; missing trailing values, nulls and NaN give 0 bits; a
row is no neighbour of itself (repeated ids count once); ties go to the
smaller id; fewer than k other rows give all of them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

SEGMENT = 16
TOP = 10


def codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(id, code) rows, code an array of segment values, and the segments."""
    known = vectors.where(F.col(id_col).isNotNull() & (F.size(F.coalesce(vec_col, F.array())) > 0))
    dims = known.agg(F.max(F.size(vec_col)).alias("d")).first()["d"] or 0
    n = -(-dims // SEGMENT)
    on = lambda i: F.coalesce(F.get(F.col(vec_col), F.lit(i)), F.lit(0.0))              # noqa: E731
    bit = lambda i: F.when((on(i) > 0) & ~F.isnan(on(i)), 1 << (i % SEGMENT)).otherwise(0)
    segs = [sum((bit(i) for i in range(s * SEGMENT, min(dims, (s + 1) * SEGMENT))), F.lit(0)) for s in range(n)]
    code = F.array(*[s.cast("int") for s in segs]) if n else F.array().cast("array<int>")
    return known.select(F.col(id_col).alias("id"), code.alias("code")).distinct(), n


def _far(a: str, b: str, s: int) -> Column:
    return F.bit_count(F.col(a)[s].bitwiseXOR(F.col(b)[s]))


def _least_ids(coded: DataFrame, n: int) -> DataFrame:
    """Distinct codes with their ``n`` smallest ids: salted, so that a code
    held by many rows is reduced by many tasks first."""
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    w = Window.partitionBy("code", "salt").orderBy("id")
    few = salted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return few.groupBy("code").agg(F.slice(F.sort_array(F.collect_list("id")), 1, n).alias("ids"))


def search(coded: DataFrame, segments: int, asked: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest other rows of every row
    of ``coded`` where ``asked`` holds."""
    base = shared_table(_least_ids(coded, k + 1), "codes")
    posts = shared_table(base.select("code", F.posexplode("code").alias("seg", "val")), "postings")
    queries = shared_table(coded.where(asked).select(F.col("code").alias("q")).distinct(), "queries")
    open_q, best, met, done = queries, None, None, []
    for r in range(SEGMENT + 1):
        ring = [sum(1 << i for i in c) for c in combinations(range(SEGMENT), r)]
        masks = F.array(*[F.lit(m) for m in ring]) if len(ring) <= 2000 else F.filter(
            F.sequence(F.lit(0), F.lit((1 << SEGMENT) - 1)), lambda m: F.bit_count(m) == r)
        probes = open_q.select("q", F.posexplode("q").alias("seg", "own")).select(
            "q", "seg", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("own")))).alias("val"))
        hits = probes.hint("merge").join(posts, ["seg", "val"])     # far more probes than queries
        first = F.lit(True)                            # least segment distance is r, first met here
        for s in range(segments):
            ok = F.when(F.col("seg") > s, _far("q", "code", s) > r).otherwise(_far("q", "code", s) >= r)
            first = first & ok
        near = sum((_far("q", "code", s) for s in range(segments)), F.lit(0))
        found = hits.where(first).select("q", "code", near.alias("distance")).join(base, "code")
        best = found if best is None else best.unionByName(found)
        w = Window.partitionBy("q").orderBy("distance", F.col("ids")[0])
        best = shared_table(best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).drop("n"),
                            "nearest")
        # enough rows other than the query within the covered radius?
        covered = segments * (r + 1) - 1
        enough = (best.where(F.col("distance") <= covered).groupBy("q")
                  .agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") >= k + 1).select("q"))
        last = r == SEGMENT
        finished = open_q if last else enough.join(open_q, "q")
        done.append(shared_table(best.join(finished, "q", "left_semi"), "finished"))
        open_q = shared_table(open_q.join(enough, "q", "left_anti"), "open")
        if last or open_q.isEmpty():
            break
        best = best.join(open_q, "q", "left_semi")
    near = done[0]
    for d in done[1:]:
        near = near.unionByName(d)
    rows = near.select("q", "distance", F.explode("ids").alias("id"))
    w = Window.partitionBy("q").orderBy("distance", "id")
    rows = (rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
            .groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near")))
    others = lambda c: F.slice(F.filter(c, lambda x: x["id"] != F.col("query_id")), 1, k)
    return (coded.where(asked).select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(rows, "q")
            .select("query_id", F.posexplode(others(F.col("near"))).alias("pos", "x"))
            .select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("id"),
                    F.col("x.distance").alias("distance")))
