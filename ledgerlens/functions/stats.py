"""Exact statistics that stay distributed.

* ``median_by``      exact median per key for *bounded* groups (a company has at
                      most one row per year): Spark's ``median`` with partial
                      aggregation, one shuffle for all columns.
* ``hot_median_by``  exact median for groups of any size (a sector-year or the
                      whole panel may hold a third of all rows).  Values fall
                      into buckets of 0.14% relative width; pre-aggregated
                      bucket counts tell which bucket holds the middle rank(s);
                      a bucket of many values is cut into 4096 equal parts
                      between its least and greatest value, again and again
                      until a part holds few rows or one value.  No task ever
                      ranks more than ``LEAF_ROWS`` rows.
* ``fill_with_medians``  coalesce columns with a per-key (or global) median.
* ``percentiles``   linear-interpolation percentiles (numpy default).
* ``pair_corr``     pairwise-complete Pearson correlation, NULL when constant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# First buckets per doubling of |v|, and an offset above the exponents of doubles.
BUCKETS_PER_OCTAVE, OCTAVES = 512, 1100
# Parts that a bucket of more than LEAF_ROWS rows is cut into.
PARTS, LEAF_ROWS = 4096, 100_000
# Largest per-group median table that is broadcast back to the rows.
BROADCAST_MAX_GROUPS = 200_000


def _long_form(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys..., col, v) rows for the non-null values of ``cols``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v"))
                      for c in cols])
    return (df.select(*keys, F.explode(pairs).alias("kv"))
              .select(*keys, F.col("kv.col").alias("col"), F.col("kv.v").alias("v"))
              .where(F.col("v").isNotNull() & ~F.isnan("v")))


def _log_bucket(v: Column) -> Column:
    """A bucket number that never falls as v grows, of 0.14% relative width at
    every magnitude; zero has its own."""
    octave = F.least(F.greatest(F.log2(F.abs(v)), F.lit(-float(OCTAVES))), F.lit(float(OCTAVES)))
    size = F.floor((octave + OCTAVES) * BUCKETS_PER_OCTAVE) + 1
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def median_by(df: DataFrame, keys: list[str], cols: list[str],
              suffix: str = "_median") -> DataFrame:
    """Exact median of each column per key, for groups of bounded size."""
    return df.groupBy(*keys).agg(*[F.median(c).alias(c + suffix) for c in cols])


def hot_quantiles_by(df: DataFrame, keys: list[str], cols: list[str],
                     ps: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles per key for groups of any size.

    Returns (keys..., col, q_0, q_1, ...) in long form, one row per group and
    column with at least one non-null value.  Same interpolation as Spark's
    ``percentile`` and DuckDB's ``quantile_cont``:
    ``(hi_rank - pos) * v[lo_rank] + (pos - lo_rank) * v[hi_rank]``.
    """
    gk = list(keys) + ["col"]
    long = _long_form(df, keys, cols).withColumn("bucket", _log_bucket(F.col("v")))
    rank_cols = [f"{side}{i}" for i in range(len(ps)) for side in ("lo", "hi")]
    hit = lambda k: (F.col("before") <= F.col(k)) & (F.col(k) < F.col("before") + F.col("c"))
    state = ["n"] + [f"pos{i}" for i in range(len(ps))] + rank_cols
    span = [*gk, "bucket", "least", "most"]

    def holding_a_rank(hist: DataFrame, within: list[str], order: str) -> DataFrame:
        # counts only: one row per bucket, however many rows a group has
        w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        told = hist.withColumn("before", F.col("before") + F.sum("c").over(w) - F.col("c"))
        return told.where(reduce(lambda a, b: a | b, [hit(k) for k in rank_cols]))

    def rows_of(target: DataFrame, size: int) -> DataFrame:
        # the (few) rows between the ends of a target; a hot group is not shuffled
        target = F.broadcast(target) if size <= BROADCAST_MAX_GROUPS else target
        return long.join(target, on=gk + ["bucket"]).where(F.col("v").between(F.col("least"), F.col("most")))

    counts = [F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most")]
    # 1) bucket histogram per group (partial aggregation map-side) and the wanted ranks
    hist = long.groupBy(*gk, "bucket").agg(*counts).withColumns({
        "n": F.sum("c").over(Window.partitionBy(*gk)), "before": F.lit(0).cast("long")})
    for i, p in enumerate(ps):
        hist = hist.withColumn(f"pos{i}", (F.col("n") - 1).cast("double") * F.lit(float(p)))
        hist = hist.withColumns({f"lo{i}": F.floor(f"pos{i}").cast("long"),
                                 f"hi{i}": F.ceil(f"pos{i}").cast("long")})
    target = cut_lineage(holding_a_rank(hist, gk, "bucket").select(*span, "before", "c", *state))
    # 2) cut the large ones; both ends leave for different parts, so counts fall,
    #    and a bucket spans fewer than 4096^4 doubles, so four rounds end it
    large = (F.col("c") > LEAF_ROWS) & (F.col("least") < F.col("most"))
    while True:
        size, n_large = target.agg(F.count(F.lit(1)), F.count_if(large)).first()
        if not n_large:
            break
        part = F.least(F.floor((F.col("v") - F.col("least")) / (F.col("most") - F.col("least")) * PARTS),
                       F.lit(PARTS - 1)).cast("int")
        cut = (rows_of(target.where(large).drop("c"), size)
               .withColumns({"part": part, "from": F.col("least")})
               .groupBy(*gk, "bucket", "from", "before", *state, "part").agg(*counts))
        cut = holding_a_rank(cut, gk + ["bucket", "from"], "part")
        target = cut_lineage(target.where(~large).unionByName(cut.select(*target.columns)))
    # 3) rank the distinct values of what is left
    vals = (rows_of(target.drop("c"), size).groupBy(*span, "before", *state, "v")
            .agg(F.count(F.lit(1)).alias("c")))
    w2 = Window.partitionBy(*span).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    vals = vals.withColumn("before", F.col("before") + F.sum("c").over(w2) - F.col("c"))
    picked = vals.groupBy(*gk).agg(
        F.first("n").alias("n"),
        *[F.first(f"pos{i}").alias(f"pos{i}") for i in range(len(ps))],
        *[F.max(F.when(hit(k), F.col("v"))).alias("v_" + k) for k in rank_cols])
    outs = []
    for i in range(len(ps)):
        lo, hi, pos = F.col(f"v_lo{i}"), F.col(f"v_hi{i}"), F.col(f"pos{i}")
        rlo, rhi = F.floor(pos), F.ceil(pos)
        outs.append(F.when(rlo == rhi, lo)
                     .otherwise((rhi - pos) * lo + (pos - rlo) * hi).alias(f"q_{i}"))
    return picked.select(*gk, *outs)


def hot_median_by(df: DataFrame, keys: list[str], cols: list[str],
                  suffix: str = "_median") -> DataFrame:
    """Exact median of each column per key (``keys`` may be empty = global),
    safe for groups that hold a large share of all rows.  Wide result: one
    ``<col><suffix>`` column per input column (the long-to-wide step is a
    conditional aggregate, not a separate pivot)."""
    med = hot_quantiles_by(df, keys, cols, [0.5])
    wide = med.groupBy(*keys).agg(
        *[F.max(F.when(F.col("col") == c, F.col("q_0"))).alias(c + suffix) for c in cols])
    return wide


def null_profile(df: DataFrame, cols: list[str]) -> tuple[int, list[str]]:
    """The number of rows and the columns that hold at least one NULL (one
    counting pass)."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return row["__n"], [c for c in cols if row[c]]


def fill_with_medians(df: DataFrame, keys: list[str], cols: list[str], hot: bool = False) -> DataFrame:
    """``x.fillna(x.median())`` per key (``transform('median')``) for all
    ``cols`` in one aggregate and one join.  Empty ``keys`` = global median:
    a one-row aggregate whose values are inlined as literals (the way Spark
    runs an uncorrelated scalar subquery), so no join at all.

    Like the analysed pipeline's ``if df[col].isnull().any()`` guard, a
    counting pass first drops columns without NULLs; when none is left the
    frame is returned unchanged and no median is computed.  It also counts the
    rows: groups of a frame of at most ``LEAF_ROWS`` rows are as small as the
    last parts that :func:`hot_quantiles_by` ranks, so one exact aggregate is
    enough for them."""
    if not cols:
        return df
    n, cols = null_profile(df, cols)
    if not cols:
        return df
    medians = hot_median_by if (hot or not keys) and n > LEAF_ROWS else median_by
    if not keys:
        row = medians(df, [], cols, "__m").first()
        vals = {c: (row[c + "__m"] if row is not None else None) for c in cols}
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(vals[c]).cast("double"))
                               for c in cols if vals[c] is not None})
    med = medians(df, keys, cols, "__m")
    if hot and n > LEAF_ROWS:
        # Hot keys (a sector-year may hold a third of the rows) must not be
        # shuffled to one task for the join: the group table is written once
        # and broadcast when its row count is within the checked bound; above
        # it, a shuffle join with AQE's skew-join splitting is used.
        med = cut_lineage(med)
        if med.count() <= BROADCAST_MAX_GROUPS:
            med = F.broadcast(med)
    elif hot:
        med = F.broadcast(med)                      # at most LEAF_ROWS groups
    joined = df.join(med, on=keys, how="left")
    return joined.select(
        *[F.coalesce(F.col(c), F.col(c + "__m")).alias(c) if c in cols else F.col(c)
          for c in df.columns])


def percentiles(v: Column, ps: list[float]) -> Column:
    """Exact percentiles with linear interpolation (numpy's default)."""
    return F.percentile(v, F.array(*[F.lit(float(p)) for p in ps]))


def pair_corr(a: str, b: str) -> Column:
    """Pearson correlation over rows where both are non-null; NULL when one
    side is constant (pandas gives NaN, Spark ``corr`` may raise in ANSI)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x = F.when(both, F.col(a).cast("double"))
    y = F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
