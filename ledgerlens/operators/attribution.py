"""Attributions.

Per-row, per-feature additive contributions.  For boosted trees they come from
path-dependent TreeSHAP (Lundberg et al., 2018, "Consistent Individualized
Feature Attribution for Tree Ensembles") inside ``mapInPandas``: each task
explains its own Arrow batches, vectorised over the rows of the batch, with the
node arrays as a broadcast variable (bounded by trees x nodes, not by the
data).  A leaf's contributions depend on which of its path's decisions a row
fulfils, and on nothing else of the row; so they are computed once for every
pattern, the leaves below a node together, and looked up for each row.  For a
linear scorer they are ``w * (x - mean(x))`` as expressions.

Both give the same wide table, one array of contributions a row.  Rows are
chosen before the model explains them (one firm's row, the latest row of each
firm, a sample), and importances are taken per array position: the long table
of rows x features is only made where it is the result.

Local accuracy holds by construction: base value + sum of contributions =
the model's prediction.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dealt, ship_package

EXPLAINED_ROWS = 20_000         # rows that a task explains at most, about
TABLE_BITS = 12                 # decisions of a table at most; deeper trees are walked a row at a time
BELOW = 2                       # levels of decisions below a table's top node


# ------------------------------------------------------------ tree table --

def model_trees(model) -> list[dict]:
    """Node arrays of a fitted ensemble's trees."""
    trees = []
    for t in model.trees:
        feature = np.array(t.feature)
        threshold = np.array([model.cuts[f][b] if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin)])
        trees.append({"left": np.array(t.left), "right": np.array(t.right), "feature": feature, "threshold": threshold,
                      "value": np.array(t.value, float), "cover": np.maximum(np.array(t.rows, float), 1e-12), "root": 0,
                      "weight": 1.0, "expected": _expected(t)})
    return trees


def _expected(t) -> float:
    """Mean value of a tree's leaves over the rows it was grown on."""
    def of(j: int) -> float:
        if t.left[j] < 0:
            return t.value[j]
        a, b = t.left[j], t.right[j]
        return (t.rows[a] * of(a) + t.rows[b] * of(b)) / max(1, t.rows[a] + t.rows[b])
    return float(of(0))


# -------------------------------------------------------------- TreeSHAP --

def _extend(path, pz, po, pi):
    """Path entries: [feature, zero_frac (scalar), one_frac (vector), weight (vector)]."""
    depth = len(path)
    n = po.shape[0]
    new = [list(p) for p in path] + [[pi, pz, po, np.ones(n) if depth == 0 else np.zeros(n)]]
    for i in range(depth - 1, -1, -1):
        new[i + 1][3] = new[i + 1][3] + po * new[i][3] * (i + 1) / (depth + 1)
        new[i][3] = pz * new[i][3] * (depth - i) / (depth + 1)
    return new


def _unwind(path, idx):
    depth = len(path) - 1
    one, zero = path[idx][2], path[idx][1]
    nxt = path[depth][3].copy()
    out = [list(p) for p in path[:depth]]
    nz_one = one != 0
    safe_one = np.where(nz_one, one, 1.0)
    for j in range(depth - 1, -1, -1):
        w_one = nxt * (depth + 1) / ((j + 1) * safe_one)
        w_zero = (out[j][3] * (depth + 1)) / (zero * (depth - j)) if zero != 0 else np.zeros_like(nxt)
        tmp = out[j][3]
        new_w = np.where(nz_one, w_one, w_zero)
        nxt = np.where(nz_one, tmp - new_w * zero * (depth - j) / (depth + 1), nxt)
        out[j][3] = new_w
    for j in range(idx, depth):
        out[j][0], out[j][1], out[j][2] = path[j + 1][0], path[j + 1][1], path[j + 1][2]
    return out


def _unwound_sum(path, idx):
    depth = len(path) - 1
    one, zero = path[idx][2], path[idx][1]
    nxt = path[depth][3].copy()
    total = np.zeros_like(nxt)
    nz_one = one != 0
    safe_one = np.where(nz_one, one, 1.0)
    for i in range(depth - 1, -1, -1):
        tmp = nxt * (depth + 1) / ((i + 1) * safe_one)
        alt = (path[i][3] / zero) / ((depth - i) / (depth + 1)) if zero != 0 else np.zeros_like(nxt)
        total = total + np.where(nz_one, tmp, alt)
        nxt = np.where(nz_one, path[i][3] - tmp * zero * ((depth - i) / (depth + 1)), nxt)
    return total


def tree_shap(X: np.ndarray, tree: dict, phi: np.ndarray) -> None:
    """Add one tree's contributions for all rows of ``X`` into ``phi``
    (rows x features)."""
    left, right, feat = tree["left"], tree["right"], tree["feature"]
    thr, val, cover = tree["threshold"], tree["value"], tree["cover"]
    n = X.shape[0]

    def recurse(j, path, pz, po, pi):
        path = _extend(path, pz, po, pi)
        if left[j] < 0:
            for i in range(1, len(path)):
                w = _unwound_sum(path, i)
                phi[:, path[i][0]] += w * (path[i][2] - path[i][1]) * val[j]
            return
        d = int(feat[j])
        goes_left = (X[:, d] <= thr[j]).astype(float)
        iz, io = 1.0, np.ones(n)
        k = next((i for i in range(1, len(path)) if path[i][0] == d), None)
        if k is not None:
            iz, io = path[k][1], path[k][2]
            path = _unwind(path, k)
        a, b = int(left[j]), int(right[j])
        recurse(a, path, iz * cover[a] / cover[j], io * goes_left, d)
        recurse(b, path, iz * cover[b] / cover[j], io * (1.0 - goes_left), d)

    recurse(tree["root"], [], 1.0, np.ones(n), -1)


def _leaf_paths(tree: dict) -> list[tuple[int, list[tuple[int, bool, float]]]]:
    """(leaf, its path as (node, whether it goes right, share of rows kept))."""
    at, out = [(tree["root"], [])], []
    while at:
        j, path = at.pop()
        if tree["left"][j] < 0:
            out.append((j, path))
            continue
        for child, right in ((int(tree["left"][j]), False), (int(tree["right"][j]), True)):
            at.append((child, path + [(j, right, tree["cover"][child] / tree["cover"][j])]))
    return out


def _pattern_values(zero: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Shapley values (leaves x 2^m patterns x m features) of leaves whose m
    features keep shares ``zero`` of the rows if unknown; bit i of a pattern is
    set where a row fulfils all decisions on feature i.  A feature with share 1
    that is fulfilled has no part, so it can fill up shorter paths."""
    n, m = zero.shape
    ones = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    out = np.empty((n, 1 << m, m))
    weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
    for i in range(m):
        sums = [np.ones((n, 1 << m))]                    # by number of known features: products of the others' shares
        for j in (j for j in range(m) if j != i):
            z, o = zero[:, j, None], ones[None, :, j]
            sums = [a * z + b * o for a, b in zip([*sums, 0.0], [0.0, *sums])]
        out[:, :, i] = sum(w * s for w, s in zip(weight, sums)) * (ones[None, :, i] - zero[:, i, None]) * value[:, None]
    return out


def shap_tables(tree: dict) -> list[tuple] | None:
    """The tree's contributions by decision patterns: (nodes whose decisions
    make up the pattern, features, contributions (features x patterns)) per
    group of leaves below one node; bit i of a pattern is set where a row goes
    left at the i-th node.  None if the tree is too deep for it."""
    leaves = _leaf_paths(tree)
    if len(leaves) == 1:
        return []
    if max(len(path) for _, path in leaves) > TABLE_BITS - 2 ** BELOW:
        return None
    height, inside = {}, {}                              # decisions below a node: levels and nodes

    def measure(j: int) -> int:
        a, b = int(tree["left"][j]), int(tree["right"][j])
        height[j] = 0 if a < 0 else 1 + max(measure(a), measure(b))
        inside[j] = [] if a < 0 else [j, *inside[a], *inside[b]]
        return height[j]
    measure(tree["root"])
    kept = [{} for _ in leaves]                          # per leaf: share kept by feature
    for shares, (_, path) in zip(kept, leaves):
        for j, _, share in path:
            f = int(tree["feature"][j])
            shares[f] = shares.get(f, 1.0) * share
    m = max(map(len, kept))
    zero = np.array([[*shares.values()] + [1.0] * (m - len(shares)) for shares in kept])
    values = _pattern_values(zero, np.array([tree["value"][leaf] for leaf, _ in leaves]))
    groups: dict[int, list[int]] = {}
    for at, (leaf, path) in enumerate(leaves):
        top = next((j for j, *_ in path if height[j] <= BELOW), leaf)
        groups.setdefault(top, []).append(at)
    out = []
    for top, members in groups.items():
        path = [j for j, *_ in leaves[members[0]][1]]
        nodes = (path[: path.index(top)] if top in path else path) + inside[top]
        left = {j: np.arange(1 << len(nodes)) >> i & 1 == 1 for i, j in enumerate(nodes)}
        table: dict[int, np.ndarray] = {}
        for at in members:
            good = {f: np.ones(1 << len(nodes), bool) for f in kept[at]}
            for j, goes_right, _ in leaves[at][1]:
                good[int(tree["feature"][j])] &= left[j] != goes_right
            code = np.full(1 << len(nodes), (1 << m) - (1 << len(good)))
            for i, fulfilled in enumerate(good.values()):
                code += fulfilled.astype(code.dtype) << i
            for i, f in enumerate(good):
                table[f] = table.get(f, 0.0) + values[at, :, i][code]
        out.append((tuple(nodes), list(table), np.stack(list(table.values()))))
    return out


def _add_from_tables(X: np.ndarray, tree: dict, tables: list[tuple], phi: np.ndarray) -> None:
    """Add one tree's contributions for all rows into ``phi``; both arrays are
    features x rows."""
    kind = np.uint8 if max(len(nodes) for nodes, *_ in tables) <= 8 else np.uint16
    left = {j: (X[int(f)] <= t).view(np.uint8).astype(kind, copy=False)
            for j, (f, t, a) in enumerate(zip(tree["feature"], tree["threshold"], tree["left"])) if a >= 0}
    codes: dict[tuple, np.ndarray] = {}

    def code(nodes: tuple) -> np.ndarray:
        if nodes not in codes:
            last = left[nodes[-1]] << (len(nodes) - 1)
            codes[nodes] = code(nodes[:-1]) | last if len(nodes) > 1 else last
        return codes[nodes]
    for nodes, features, values in tables:
        found = values.take(code(nodes).astype(np.intp), axis=1, mode="clip")
        for f, v in zip(features, found):
            np.add(phi[f], v, out=phi[f])


def explain_batch(X: np.ndarray, trees: list[dict]) -> np.ndarray:
    """Contributions summed over the ensemble.  The trees keep their tables, so
    a Python worker makes them once for all its tasks."""
    columns, phi = np.ascontiguousarray(X.T), np.zeros(X.shape[::-1])
    for t in trees:
        if "tables" not in t:
            t["tables"] = shap_tables(t)
        if t["tables"] is None:
            tree_shap(X, t, phi.T)
        elif t["tables"]:
            _add_from_tables(columns, t, t["tables"], phi)
    return np.ascontiguousarray(phi.T)


def attributions(df: DataFrame, model, features: list[str], target: str,
                 keys=("company", "year")) -> DataFrame:
    """Wide attribution table (keys, target, base_value, prediction,
    contributions array aligned with ``features``), computed per Arrow batch
    on the executors."""
    spark = df.sparkSession
    ship_package(spark)
    trees = model_trees(model)
    bc = spark.sparkContext.broadcast(trees)
    base = model.base + sum(t["expected"] for t in trees)
    feats = list(features)
    keys = list(keys)

    def run(batches):
        ts = bc.value
        for pdf in batches:
            X = pdf[feats].to_numpy(dtype=float, na_value=0.0)
            phi = explain_batch(X, ts)
            out = pdf[keys].copy()
            out["target"] = target
            out["base_value"] = base
            out["prediction"] = base + phi.sum(axis=1)
            out["contributions"] = list(phi)
            yield out

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    schema += ", target string, base_value double, prediction double, contributions array<double>"
    src = df.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in feats])
    return dealt(src, df.count(), EXPLAINED_ROWS).mapInPandas(run, schema)


def linear_attributions(df: DataFrame, scorer: dict, features: list[str], target: str,
                        keys=("company", "year"), over: DataFrame | None = None) -> DataFrame:
    """I18 for a linear scorer: contributions ``w * (x - mean(x))``, the mean
    over ``over`` (default: the explained rows); missing values count as 0."""
    intercept, terms = scorer[target]
    weight = dict(terms)
    x = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in weight}
    means = (df if over is None else over).agg(F.struct(*[F.avg(x[f]).alias(f) for f in weight]).alias("m")).select("m").scalar()
    rows = df.withColumn("__m", means)
    mine = F.array(*[F.lit(float(weight[f])) * (x[f] - F.col("__m")[f]) if f in weight else F.lit(0.0) for f in features])
    base = sum((F.lit(float(w)) * F.col("__m")[f] for f, w in terms), F.lit(float(intercept)))
    out = rows.select(*keys, F.lit(target).alias("target"), base.alias("base_value"), mine.alias("contributions"))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)
    return out.select(*keys, "target", "base_value", (F.col("base_value") + total).alias("prediction"), "contributions")


def long_form(wide: DataFrame, features: list[str], keys=("company", "year")) -> DataFrame:
    """(keys, target, feature, contribution) by ``posexplode`` of the array."""
    names = F.array(*[F.lit(f) for f in features])
    x = wide.select(*keys, "target", F.posexplode("contributions").alias("pos", "contribution"))
    return x.select(*keys, "target", names[F.col("pos")].alias("feature"), "contribution")


def _per_feature(wide: DataFrame, features: list[str], measure, name: str) -> DataFrame:
    """(target, feature, name): a mean per array position, one row a target
    before it is turned around."""
    one = wide.groupBy("target").agg(*[F.avg(measure(F.col("contributions")[i])).alias(f) for i, f in enumerate(features)])
    return one.unpivot("target", list(features), "feature", name)


def global_importance(wide: DataFrame, features: list[str], k: int | None = 15) -> DataFrame:
    """Mean |contribution| per feature, top k (None: all)."""
    out = _per_feature(wide, features, F.abs, "importance")
    return out if k is None else out.orderBy(F.desc("importance"), "feature").limit(k)


def risk_drivers(wide: DataFrame, features: list[str], k: int = 10) -> DataFrame:
    """Mean |negative contribution| per feature (others ignored), top k."""
    return (_per_feature(wide, features, lambda c: F.when(c < 0, -c), "mean_negative")
            .where(F.col("mean_negative").isNotNull()).orderBy(F.desc("mean_negative"), "feature").limit(k))


def firm_row(df: DataFrame, firms: list[str]) -> DataFrame:
    """The first year's row of the first listed firm that exists."""
    pos = F.array_position(F.array(*[F.lit(f) for f in firms]), F.col("company"))
    return df.where(F.col("company").isin(*firms)).withColumn("__p", pos).orderBy("__p", "year").limit(1).drop("__p")


def latest_rows(df: DataFrame) -> DataFrame:
    """H3: each firm's row of its latest year."""
    year = df.groupBy("company").agg(F.max("year").alias("year"))
    return df.join(year, ["company", "year"], "left_semi")


def negative_contributors(wide: DataFrame, features: list[str], k: int = 5, below: float = -0.001) -> DataFrame:
    """H3: a row's k most negative contributions below the threshold, from its
    own array (no long table, no window)."""
    pairs = F.arrays_zip(F.col("contributions").alias("contribution"), F.array(*[F.lit(f) for f in features]).alias("feature"))
    low = F.slice(F.array_sort(F.filter(pairs, lambda p: p["contribution"] < below)), 1, k)
    return wide.select("company", "year", "target", F.posexplode(low).alias("k", "p")).select(
        "company", "year", "target", "p.feature", "p.contribution", (F.col("k") + 1).alias("k"))


def importance_comparison(imp_a: DataFrame, imp_b: DataFrame, eps: float = 1e-8, least: float | None = 1.5) -> DataFrame:
    """Importances of two targets side by side and their ratios; rows
    where one is over ``least`` times the other, largest ratio first."""
    a = imp_a.select("feature", F.col("importance").alias("importance_a"))
    b = imp_b.select("feature", F.col("importance").alias("importance_b"))
    j = a.join(b, "feature").select(
        "feature", "importance_a", "importance_b",
        (F.col("importance_a") / (F.col("importance_b") + eps)).alias("ratio_a_over_b"),
        (F.col("importance_b") / (F.col("importance_a") + eps)).alias("ratio_b_over_a"))
    if least is not None:
        j = j.where((F.col("ratio_a_over_b") > least) | (F.col("ratio_b_over_a") > least))
    return j.orderBy(F.desc(F.greatest("ratio_a_over_b", "ratio_b_over_a")), "feature")


def top_in_other(imp_a: DataFrame, imp_b: DataFrame, k: int = 10) -> DataFrame:
    """The k most important features of one target with their importance
    for the other, 0 where it has none."""
    top = imp_a.orderBy(F.desc("importance"), "feature").limit(k).select("feature", F.col("importance").alias("importance_a"))
    other = imp_b.select("feature", F.col("importance").alias("importance_b"))
    return (top.join(other, "feature", "left").withColumn("importance_b", F.coalesce("importance_b", F.lit(0.0)))
            .orderBy(F.desc("importance_a"), "feature"))


def dependence_pairs(wide: DataFrame, features: list[str], values: DataFrame, top: list[str],
                     keys=("company", "year")) -> DataFrame:
    """Feature value vs contribution for the top features."""
    at = {f: i for i, f in enumerate(features)}
    both = wide.join(values.select(*keys, *top), list(keys))
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                               F.col("contributions")[at[f]].alias("contribution")) for f in top])
    return both.select(*keys, "target", F.explode(pairs).alias("p")).select(*keys, "target", "p.*")
