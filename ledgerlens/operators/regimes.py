"""Macro regimes.

The period table has one row per period (year): :func:`period_table` picks the
row where the panel's rows of a period disagree, and refuses more periods than
``MAX_PERIODS``.  Windows, broadcasts and clustering only ever see that table.
K-means runs as expressions over it, all numbers of clusters and all restarts
as rows of one job.
"""

from __future__ import annotations

import math

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import flag

MACRO_VARS = ["inflation", "fed_rate", "gdp_growth", "stress_intensity"]
# Candidate columns per macro series, first present wins.
MACRO_CANDIDATES = {"inflation": ["inflation"], "interest_rate": ["fed_rate"],
                    "gdp_growth": ["gdp_growth", "gdp"], "stress": ["stress_intensity"]}


def parallel_map(fn, items, workers: int = 8) -> list:
    """Submit independent Spark ML fits as concurrent jobs (the way
    ``CrossValidator(parallelism=...)`` does); results keep item order."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    if len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(workers, len(items))) as ex:
        return list(ex.map(fn, items))
# Largest period table: broadcast, ordered by one task, held as an array.
MAX_PERIODS = 20_000


def resolve_column(df: DataFrame, candidates: list[str]) -> str | None:
    """C14: first candidate present in the schema (plan-time lookup)."""
    for c in candidates:
        if c in df.columns:
            return c
    return None


def resolved_macros(df: DataFrame) -> dict[str, str | None]:
    """C14: the column of each macro series, None where the frame has none."""
    return {name: resolve_column(df, cands) for name, cands in MACRO_CANDIDATES.items()}


def macro_columns(df: DataFrame) -> list[str]:
    """C14: the columns of the macro series that are there."""
    return [c for c in resolved_macros(df).values() if c is not None]


def macro_report(df: DataFrame) -> DataFrame:
    """C14: series, resolved column, whether it was found."""
    rows = [(name, c, c is not None) for name, c in resolved_macros(df).items()]
    return df.sparkSession.createDataFrame(rows, "series string, column_name string, found boolean")


def _variants(df: DataFrame, cols: list[str], time_col: str) -> DataFrame:
    return df.select(time_col, *cols).dropna().groupBy(time_col, *cols).agg(F.count(F.lit(1)).alias("__n"))


def period_table(df: DataFrame, cols: list[str], time_col: str = "year") -> DataFrame:
    """One row per period with complete macros.  Where the panel's rows of a
    period disagree, the values that most rows hold are taken, the least among
    equals; :func:`disagreements` lists such periods."""
    each = _variants(df, cols, time_col)
    order = F.struct((-F.col("__n")).alias("n"), *cols)
    t = each.groupBy(time_col).agg(F.min_by(F.struct(*cols), order).alias("m")).select(time_col, "m.*")
    n = t.count()
    if n > MAX_PERIODS:
        raise ValueError(f"{n} periods: more than the {MAX_PERIODS} that a period table may hold")
    return t


def disagreements(df: DataFrame, cols: list[str], time_col: str = "year") -> DataFrame:
    """Periods whose rows disagree on a macro: number of variants and of rows
    that hold another one than the period table's."""
    g = _variants(df, cols, time_col).groupBy(time_col).agg(
        F.count(F.lit(1)).alias("n_variants"), (F.sum("__n") - F.max("__n")).alias("n_other_rows"))
    return g.where("n_variants > 1")


def macro_series(df: DataFrame, time_col: str = "year", cols=None) -> DataFrame:
    """Macro time series (columns resolved from candidates) with each
    variable's mean over the periods (a window over the period table)."""
    cols = cols or macro_columns(df)
    t = period_table(df, cols, time_col)
    wall = Window.partitionBy()
    return t.select(time_col, *cols, *[F.avg(c).over(wall).alias(f"{c}_mean") for c in cols])


def regime_name(avg_infl, avg_rate, avg_gdp, avg_stress):
    """First matching rule names the regime."""
    i, r, g, s = avg_infl, avg_rate, avg_gdp, avg_stress
    return (F.when(s > 60, "HIGH_STRESS")
             .when((i > 5) & (r > 3), "HIGH_INFLATION_TIGHTENING")
             .when(i > 5, "HIGH_INFLATION")
             .when(g < 0, "RECESSION")
             .when(r > 4, "HIGH_RATES")
             .when(r <= 1, "ZERO_RATES")
             .when(g > 3, "STRONG_GROWTH")
             .otherwise("NORMAL"))


def rule_regimes(df: DataFrame, time_col: str = "year") -> DataFrame:
    """Per-period rule regime: D25 applied to each period's own macro values
    (the deterministic labelling used when no clustering is wanted); a series
    that the panel lacks matches no rule."""
    found = resolved_macros(df)
    m = period_table(df, [c for c in found.values() if c is not None], time_col)
    return m.withColumn("regime_name", regime_name(*[F.col(c) if c else F.lit(None).cast("double") for c in found.values()]))


def label_panel(panel: DataFrame, labels: DataFrame, time_col: str = "year") -> DataFrame:
    """G1: period -> label lookup; unmatched -> NULL.  The label table has one
    row per period; it is broadcast after its size is checked (a period can
    hold a large share of the panel, so it must not be shuffled to one task),
    and joined by shuffle (AQE skew splitting) beyond the bound."""
    if labels.count() <= MAX_PERIODS:
        labels = F.broadcast(labels)
    return panel.join(labels, time_col, "left")


def transitions(labels: DataFrame, label_col: str, time_col: str = "year") -> DataFrame:
    """periods whose label differs from the previous period's.  A single
    ordered window, only ever applied to the bounded period table."""
    w = Window.orderBy(time_col)
    prev = F.lag(label_col, 1).over(w)
    return (labels.select(time_col, label_col, prev.alias("previous"))
                  .where(F.col("previous").isNotNull() & (F.col("previous") != F.col(label_col))))


def standardize(t: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population std over the bounded period table."""
    wall = Window.partitionBy()
    return t.withColumns({f"z_{c}": F.try_divide(F.col(c) - F.avg(c).over(wall),
                                                 F.stddev_pop(c).over(wall)) for c in cols})


def _vectors(t: DataFrame, zcols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=zcols, outputCol="features").transform(t.na.fill(0.0, subset=zcols))


def _relabel(df: DataFrame, centers: list, raw_col: str, out_col: str) -> DataFrame:
    """Stable labels: clusters renumbered by centroid order (label switching)."""
    order = sorted(range(len(centers)), key=lambda i: tuple(round(x, 12) for x in centers[i]))
    mapping = {old: new for new, old in enumerate(order)}
    expr = None
    for old, new in mapping.items():
        cond = F.col(raw_col) == old
        expr = F.when(cond, F.lit(new)) if expr is None else expr.when(cond, F.lit(new))
    return df.withColumn(out_col, expr)


RESTARTS, ITERATIONS = 10, 40


def _squared(p: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(p, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)


def _distances(p: Column, centres: Column) -> Column:
    return F.transform(centres, lambda c: _squared(p, c))


def _nearest(p: Column, centres: Column) -> Column:
    """1-based place of the nearest centre, the first among equals."""
    d = _distances(p, centres)
    return F.array_position(d, F.array_min(d))


def _moved(points: Column, centres: Column, d: int) -> Column:
    """One Lloyd step: every centre to the mean of its points, or left alone."""
    labelled = F.transform(points, lambda p: F.struct(p["x"].alias("x"), _nearest(p["x"], centres).alias("at")))

    def total(points: Column, i: int) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda s, p: s + p["x"][i])

    def of(c: Column, j: Column) -> Column:
        mine = F.filter(labelled, lambda p: p["at"] == j + 1)
        mean = F.array(*[total(mine, i) / F.size(mine) for i in range(d)])
        return F.when(F.size(mine) == 0, c).otherwise(mean)
    return F.transform(centres, of)


def kmeans_runs(t: DataFrame, zcols: list[str], ks, time_col: str = "year", seed: int = 42,
                restarts: int = RESTARTS) -> DataFrame:
    """(k, seed, centres, inertia): Lloyd's algorithm for every number of
    clusters and every restart, one row each, in one job.  A restart begins at
    the k points whose (seed, period) hash least; the points of the period
    table reach the rows as one sorted array (a scalar subquery)."""
    spark = t.sparkSession
    x = F.struct(F.col(time_col).alias("at"), F.array(*[F.coalesce(c, F.lit(0.0)) for c in zcols]).alias("x"))
    points = t.agg(F.array_sort(F.collect_list(x)).alias("p")).select("p").scalar()       # one entry a period
    runs = spark.createDataFrame([(k, s) for k in ks for s in range(seed, seed + restarts)], "k int, seed int")
    runs = runs.repartition(spark.sparkContext.defaultParallelism, "k", "seed").withColumn("points", points)
    first = F.slice(F.array_sort(F.transform("points", lambda p: F.struct(
        F.md5(F.concat_ws(":", F.col("seed"), p["at"])).alias("h"), p["x"].alias("x")))), F.lit(1), F.col("k"))
    runs = runs.withColumn("centres", F.transform(first, lambda p: p["x"]))
    runs = runs.withColumn("centres", F.aggregate(
        F.sequence(F.lit(1), F.lit(ITERATIONS)), F.col("centres"), lambda c, _: _moved(F.col("points"), c, len(zcols))))
    inertia = F.aggregate("points", F.lit(0.0), lambda s, p: s + F.array_min(_distances(p["x"], F.col("centres"))))
    return runs.select("k", "seed", F.array_sort("centres").alias("centres"), inertia.alias("inertia"))


def best_runs(runs: DataFrame) -> DataFrame:
    """The restart of least inertia for each k, the first among equals."""
    order = F.struct(F.round("inertia", 9).alias("i"), "seed")
    return runs.groupBy("k").agg(F.min_by(F.struct("centres", "inertia"), order).alias("b")).select("k", "b.*")


def kmeans_sweep(t: DataFrame, zcols: list[str], k_max: int = 6, time_col: str = "year", seed: int = 42) -> DataFrame:
    """Inertia of the best of ten restarts for k = 1..min(k_max, n-1)."""
    ks = range(1, max(1, min(k_max, t.count() - 1)) + 1)
    return best_runs(kmeans_runs(t, zcols, ks, time_col, seed)).select("k", "inertia")


def gmm_sweep(t: DataFrame, zcols: list[str], k_max: int = 6, seed: int = 42) -> DataFrame:
    """BIC of a Gaussian mixture, with the settings of the fit, for k =
    1..min(k_max, n-1); k = 1 is closed form (Spark ML needs k >= 2)."""
    n, d = t.count(), len(zcols)
    vec = _vectors(t, zcols).cache()

    def one(k):
        ll = _single_gaussian_ll(t, zcols) if k == 1 else float("nan")
        if k > 1 and n > d:     # fewer rows leave no full covariance to fit
            ll = _mixture(k, seed).fit(vec).summary.logLikelihood
        p = k * (d + d * (d + 1) / 2) + k - 1
        return (k, -2 * ll + p * math.log(n) if ll == ll else None)

    rows = parallel_map(one, range(1, max(1, min(k_max, n - 1)) + 1))
    vec.unpersist()
    return t.sparkSession.createDataFrame(rows, "k int, gmm_bic double")


def _mixture(k: int, seed: int) -> GaussianMixture:
    return GaussianMixture(k=k, seed=seed, maxIter=200, tol=1e-6)


def _single_gaussian_ll(t: DataFrame, zcols: list[str]) -> float:
    """Log-likelihood of one full-covariance Gaussian (MLE) on the rows."""
    import numpy as np
    from pyspark.ml.stat import Summarizer
    vec = _vectors(t, zcols)
    n = vec.count()
    mean = np.array(vec.select(Summarizer.mean(F.col("features"))).first()[0])
    cov_rows = vec.select(vector_to_array("features").alias("x")).select(
        *[F.avg((F.col("x")[i] - float(mean[i])) * (F.col("x")[j] - float(mean[j]))).alias(f"c{i}_{j}")
          for i in range(len(zcols)) for j in range(len(zcols))]).first()
    d = len(zcols)
    cov = np.array(list(cov_rows)).reshape(d, d) + np.eye(d) * 1e-6
    sign, logdet = np.linalg.slogdet(cov)
    return float(-0.5 * n * (d * math.log(2 * math.pi) + logdet + d))


def choose_k(sweep: DataFrame) -> DataFrame:
    """Elbow rule: argmin of the first two inertia drops + 2, capped at 4;
    3 when the sweep has fewer than 3 points (one row, column ``k``)."""
    w = Window.orderBy("k")     # bounded: one row per k
    d = sweep.select("k", (F.col("inertia") - F.lag("inertia").over(w)).alias("drop"))
    early = F.col("k").isin(2, 3) & F.col("drop").isNotNull()
    a = d.agg(F.count(F.lit(1)).alias("n"),
              F.min_by(F.when(early, F.col("k")), F.when(early, F.struct("drop", "k"))).alias("elbow"))
    return a.select(F.when(F.col("n") >= 3, F.least(F.col("elbow"), F.lit(4)))
                     .otherwise(F.lit(3)).alias("k"))


def fit_kmeans(t: DataFrame, zcols: list[str], k: int, time_col: str = "year", seed: int = 42) -> DataFrame:
    """I4: the periods with their label of the best of ten restarts; labels are
    numbered in the order of the centres."""
    best = best_runs(kmeans_runs(t, zcols, [k], time_col, seed))
    x = F.array(*[F.coalesce(c, F.lit(0.0)) for c in zcols])
    out = t.withColumn("__c", best.select("centres").scalar())
    return out.withColumn("regime_kmeans", (_nearest(x, F.col("__c")) - 1).cast("int")).drop("__c")


def fit_gmm(t: DataFrame, zcols: list[str], k: int, seed: int = 42) -> DataFrame:
    """Gaussian mixture labels, class probabilities and confidence
    (max probability); components renumbered by mean order.  Adds a
    low-confidence flag when rows are fewer than the parameter count."""
    vec = _vectors(t, zcols)
    m = _mixture(k, seed).fit(vec)
    means = [list(map(float, g.mean)) for g in m.gaussians]
    order = sorted(range(k), key=lambda i: tuple(round(x, 12) for x in means[i]))
    out = m.transform(vec).withColumn("p", vector_to_array("probability"))
    out = _relabel(out, means, "prediction", "regime_gmm")
    out = out.withColumns({f"regime_prob_{new}": F.col("p")[old] for new, old in enumerate(order)})
    d = len(zcols)
    p = k * (d + d * (d + 1) / 2) + k - 1
    n = t.count()
    return out.withColumns({
        "regime_confidence": F.array_max("p"),
        "low_confidence": F.lit(n < p),
    }).drop("p", "prediction", "probability")


def cluster_profile(labelled: DataFrame, label_col: str, cols: list[str],
                    time_col: str = "year") -> DataFrame:
    """Mean of each macro variable and the sorted period list per label,
    plus D25 names from the means."""
    g = labelled.groupBy(label_col).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in cols],
        F.array_sort(F.collect_list(time_col)).alias("periods"),
        F.count(F.lit(1)).alias("n_periods"))
    if all(c in cols for c in MACRO_VARS):
        g = g.withColumn("regime_name", regime_name(*[F.col(f"avg_{c}") for c in MACRO_VARS]))
    return g


def silhouette(labelled: DataFrame, label_col: str, zcols: list[str]) -> DataFrame:
    """Mean silhouette with Euclidean distances (one row).  Each period
    meets the array of all points of the period table: a is its mean distance
    to the others of its label, b the least mean distance to another label's
    points; a point alone under its label counts 0, a single label gives NULL."""
    x = F.array(*[F.coalesce(c, F.lit(0.0)) for c in zcols])
    mine = labelled.select(F.col(label_col).alias("label"), x.alias("x"))
    every = mine.agg(F.collect_list(F.struct("label", "x")).alias("p")).select("p").scalar()    # one entry a period
    rows = mine.withColumn("every", every)
    off = F.transform("every", lambda p: F.struct(p["label"].alias("label"), F.sqrt(_squared(p["x"], F.col("x"))).alias("d")))

    def total(points: Column) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda s, p: s + p["d"])
    rows = rows.withColumn("off", off)
    others = F.array_except(F.array_distinct(F.transform("off", lambda p: p["label"])), F.array("label"))
    own = F.filter("off", lambda p: p["label"] == F.col("label"))
    rows = rows.withColumns({"own": own, "others": others})
    mean_of = F.transform("others", lambda o: F.transform(F.array(F.filter("off", lambda p: p["label"] == o)), lambda g: total(g) / F.size(g))[0])
    rows = rows.withColumns({"n": F.size("own"), "a": F.try_divide(total(F.col("own")), F.size("own") - 1), "b": F.array_min(mean_of)})
    s = (F.when(F.size("others") == 0, F.lit(None)).when(F.col("n") == 1, 0.0)
         .otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))))
    return rows.agg(F.avg(s.cast("double")).alias("silhouette"))


def silhouette_band(value: Column) -> Column:
    """Bands of the Euclidean silhouette."""
    return F.when(value > 0.5, "strong").when(value > 0.3, "reasonable").otherwise("weak")


def pca2(t: DataFrame, zcols: list[str]):
    """I8: two-component PCA projection and explained variance ratio; signs
    fixed so each component's largest-magnitude loading is positive."""
    vec = _vectors(t, zcols)
    m = PCA(k=2, inputCol="features", outputCol="pc").fit(vec)
    pcm = m.pc.toArray()
    signs = [1.0 if pcm[abs(pcm[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    out = m.transform(vec).withColumn("pcs", vector_to_array("pc")).select(
        "*", (F.col("pcs")[0] * signs[0]).alias("pc1"), (F.col("pcs")[1] * signs[1]).alias("pc2"))
    ratio = [float(x) for x in m.explainedVariance]
    return out.drop("pc", "pcs"), ratio


def regime_share(panel: DataFrame, label_col: str) -> DataFrame:
    """Share of panel rows per regime (count / total); the total is a
    window over the already aggregated, bounded regime table."""
    g = panel.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_rows"))
    return g.select(label_col, "n_rows",
                    (F.col("n_rows") * 100.0 / F.sum("n_rows").over(Window.partitionBy())).alias("share_pct"))


def regime_products(panel: DataFrame, label_col: str, k: int, ratio_cols: list[str],
                    three_way: list[str]) -> DataFrame:
    """Regime dummies and regime x feature products in one projection."""
    e = {f"regime_{r}_dummy": flag(F.col(label_col) == r) for r in range(k)}
    panel = panel.withColumns(e)
    prods = {}
    for v in [c for c in ratio_cols if c in panel.columns] + [c for c in three_way if c in panel.columns]:
        for r in range(k):
            prods[f"{v}_x_regime_{r}"] = F.col(v) * F.col(f"regime_{r}_dummy")
    return panel.withColumns(prods)


def economic_check(panel: DataFrame, label_col: str, cols=("roa", "perfect_storm_risk")) -> DataFrame:
    """Mean / std / count of key columns by regime."""
    return panel.groupBy(label_col).agg(
        *[e for c in cols for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))],
        F.count(F.lit(1)).alias("n_rows"))
