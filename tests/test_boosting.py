"""The tree trainer against hand-computed leaves, a plain trainer and itself
under other layouts."""

import pickle

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from ledgerlens.operators import attribution as AT
from ledgerlens.operators import boosting as B
from ledgerlens.operators import models as MD
from ledgerlens.operators import scenarios as S

PLAIN = dict(row_share=1.0, column_share=1.0, patience=None)


def frame(spark, x, y, split=None):
    rows = [(f"c{i}", 2000, *map(float, r), float(v), split[i] if split else "train") for i, (r, v) in enumerate(zip(x, y))]
    cols = ", ".join(f"f{j} double" for j in range(len(x[0])))
    return spark.createDataFrame(rows, f"company string, year int, {cols}, y double, split string")


def test_three_trees_have_hand_computed_leaves(spark):
    # base 2; G = (4, -4) for x = 0, 1: leaves -rate * (4 - l1) / (4 + l2) and the same up
    df = frame(spark, [[0]] * 4 + [[1]] * 4, [1] * 4 + [3] * 4)
    m = B.train(df, ["f0"], ["y"], B.BoostConfig(rounds=3, depth=1, rate=0.5, least_rows=3, **PLAIN))["y"]
    assert abs(m.base - 2.0) < 1e-8 and len(m.trees) == 3
    g = 4.0
    for tree in m.trees:
        step = 0.5 * (g - 0.1) / 5.0
        assert tree.feature == [0, -1, -1] and tree.rows == [8, 4, 4]
        assert np.allclose(tree.value[1:], [-step, step], atol=1e-8)
        assert np.isclose(tree.gain[0], 2 * (g - 0.1) ** 2 / 5.0, atol=1e-6)
        g -= 4 * step


def test_small_nodes_and_small_gradients_stay_whole(spark):
    df = frame(spark, [[0]] * 2 + [[1]] * 6, [1] * 2 + [3] * 6)
    m = B.train(df, ["f0"], ["y"], B.BoostConfig(rounds=1, depth=2, least_rows=3, **PLAIN))["y"]
    assert m.trees[0].feature == [-1]                               # two rows are too few for a leaf
    even = frame(spark, [[0], [1]] * 4, [1.0, 1.01] * 4)
    m = B.train(even, ["f0"], ["y"], B.BoostConfig(rounds=1, depth=1, l1=0.1, **PLAIN))["y"]
    assert m.trees[0].value == [0.0]                                # under the L1 threshold


def plain_trees(x, y, cfg):
    """Exhaustive boosting over all thresholds."""
    pred, trees = np.full(len(y), y.mean()), []

    def soft(g):
        return np.sign(g) * max(abs(g) - cfg.l1, 0)

    def part(g):
        return soft(g.sum()) ** 2 / (len(g) + cfg.l2)
    for _ in range(cfg.rounds):
        g, leaf = pred - y, np.zeros(len(y))

        def split(rows, depth):
            best = None
            if depth < cfg.depth:
                for j in range(x.shape[1]):
                    for c in sorted(set(x[rows, j]))[:-1]:
                        low = x[rows, j] <= c
                        if min(low.sum(), (~low).sum()) >= cfg.least_rows:
                            gain = part(g[rows[low]]) + part(g[rows[~low]]) - part(g[rows])
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, low)
            if best is None:
                leaf[rows] = -cfg.rate * soft(g[rows].sum()) / (len(rows) + cfg.l2)
                return
            split(rows[best[1]], depth + 1)
            split(rows[~best[1]], depth + 1)
        split(np.arange(len(y)), 0)
        pred = pred + leaf
        trees.append(leaf)
    return pred


def test_trees_match_exhaustive_search(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (90, 3))
    y = np.where(x[:, 0] > 5, 1.0, -2.0) * x[:, 1] + rng.normal(size=90)
    cfg = B.BoostConfig(rounds=4, depth=3, rate=0.3, **PLAIN)
    df = frame(spark, x, y)
    m = B.train(df, ["f0", "f1", "f2"], ["y"], cfg)
    got = B.arrow_scorer(m)(df, ["y"]).select(F.substring("company", 2, 9).cast("int").alias("i"), "predicted_y").orderBy("i").collect()
    assert np.allclose([r["predicted_y"] for r in got], plain_trees(x, y, cfg), atol=1e-6)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 6))
    y = np.round(x[:, 0] * 2 + np.abs(x[:, 1]) + rng.normal(size=400), 3)
    return frame(spark, x, y, ["val" if i % 5 == 0 else "train" for i in range(400)]).cache()


def test_layout_does_not_change_the_trees(spark, noisy, monkeypatch):
    cfg, feats = B.BoostConfig(rounds=12, depth=4, bins=16), [f"f{j}" for j in range(6)]
    one = B.train(noisy.repartition(3), feats, ["y"], cfg)["y"]
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)                        # a pass a level over seven blocks
    many = B.train(noisy.repartition(11), feats, ["y"], cfg)["y"]
    assert one.trees == many.trees and one.errors == many.errors and one.base == many.base


def test_the_driver_gets_a_few_numbers_a_node(noisy, monkeypatch):
    got, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda rdd: got.append(collect(rdd)) or got[-1])
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)
    B.train(noisy, [f"f{j}" for j in range(6)], ["y"], B.BoostConfig(rounds=2, depth=4, bins=64))
    assert len(got) >= 8 and max(len(pickle.dumps(g)) for g in got) < 8 * 200      # 8 nodes at most, of 6 x 64 sums each


def test_one_block_of_several_batches_is_whole(spark, noisy):
    cfg, feats = B.BoostConfig(rounds=3, depth=3, bins=16), [f"f{j}" for j in range(6)]
    one = B.train(noisy, feats, ["y"], cfg)["y"]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "150")
    try:
        several = B.train(noisy, feats, ["y"], cfg)["y"]
    finally:
        spark.conf.set(key, before)
    assert several.trees == one.trees and several.errors == one.errors and one.trees[0].rows[0] > 200


def test_patience_cuts_at_the_best_round(noisy):
    cfg, feats = B.BoostConfig(rounds=120, depth=5, rate=0.3, patience=6), [f"f{j}" for j in range(6)]
    m = B.train(noisy, feats, ["y"], cfg)["y"]
    assert m.best == 1 + int(np.argmin(m.errors)) and m.grown == min(120, m.best + 6) == len(m.errors)
    assert m.grown < 120                                            # noise: more trees do not help
    score = B.arrow_scorer({"y": m})(noisy, ["y"]).where("split = 'val'")
    rmse = score.select(F.sqrt(F.avg((F.col("y") - F.col("predicted_y")) ** 2))).first()[0]
    assert np.isclose(rmse, min(m.errors), atol=1e-5)


def test_expression_and_arrow_scores_are_equal(noisy):
    feats = [f"f{j}" for j in range(6)]
    m = B.train(noisy, feats, ["y"], B.BoostConfig(rounds=5, depth=3, patience=None))
    some = noisy.withColumn("f0", F.when(F.col("f0") > 0, F.col("f0"))).drop("f5")      # missing values and a missing feature
    a, b = (s(m)(some, ["y"]).select("company", "predicted_y") for s in (B.arrow_scorer, B.tree_scorer))
    assert a.exceptAll(b).isEmpty() and a.count() == 400
    shares = dict(m["y"].importance())
    assert abs(sum(shares.values()) - 1) < 1e-9 and max(shares, key=shares.get) == "f0"


def test_draws_take_their_share():
    keys = np.arange(20_000, dtype=np.uint64)
    a, b = (B.drawn_rows(keys, 0.8, 42, r) for r in (0, 1))
    assert abs(a.mean() - 0.8) < 0.01 and abs((a & b).mean() - 0.64) < 0.015
    assert len(B.drawn_columns(10, 0.8, 42, 3)) == 8 and len({tuple(B.drawn_columns(10, 0.8, 42, r)) for r in range(9)}) > 4


def test_no_training_rows(spark):
    df = frame(spark, [[1.0]], [2.0], ["test"])
    m = B.train(df, ["f0"], ["y"])
    assert m["y"].trees == [] and B.arrow_scorer(m)(df, ["y"]).first()["predicted_y"] == 0.0


def test_fallback_split_and_features(spark):
    df = spark.createDataFrame([(f"c{i}", 2000 + i % 5, "s", 1.0, 2.0, 0.5, 3, 1.0) for i in range(20)],
                               "company string, year int, sector string, roa double, profit_margin double, cash double, n int, roa_predicted double")
    assert MD.fallback_features(df) == ["cash", "n"]
    out = MD.fallback_matrix(df)
    assert {(r["year"], r["split"]) for r in out.collect()} == {(y, "train" if y < 2002 else "test") for y in range(2000, 2005)}


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_firms_are_dealt_by_the_rows_they_become(spark, monkeypatch):
    firms = spark.range(40).coalesce(1).select(
        F.concat(F.lit("c"), "id").alias("company"), F.lit("s").alias("sector"), (F.col("id") / 40).alias("debt_ratio"),
        F.lit(1.5).alias("current_ratio"), F.lit(2.0).alias("inflation"), F.lit(3.0).alias("fed_rate"), F.lit(1.0).alias("gdp_growth"))
    draws = spark.range(30).select(F.col("id").alias("sim_id"), *[(F.col("id") * 0.1).alias(v) for v in S.NOISE_SD])
    seen = []

    def scorer(df, targets):
        seen.append(most_in_a_task(df))
        return df.withColumn("predicted_y", F.col("inflation") * F.col("debt_ratio"))

    def both():
        means = S.bootstrap_means(firms, draws, ["y"], scorer).collect()
        return ({r["sim_id"]: round(r["mean_prediction"], 9) for r in means},
                sorted(S.score_scenarios(firms, {"inflation": 2.0, "fed_rate": 3.0, "gdp_growth": 1.0}, ["y"], scorer).collect()))
    whole = both()
    monkeypatch.setattr(S, "SCORED_ROWS", 140, raising=False)
    monkeypatch.setattr(S, "DRAWS_AT_ONCE", 7, raising=False)          # pieces of 7, 7, 7, 7 and 2 draws
    assert both() == whole and whole[0] == {i: round(i * 0.1 * 19.5 / 40, 9) for i in range(30)} and len(whole[1]) == 7 * 40
    assert seen[:2] == [40 * 30, 40 * 7] and seen[2] <= 180 and seen[3] <= 180


def test_explained_rows_are_dealt(noisy, monkeypatch):
    feats = [f"f{j}" for j in range(6)]
    m = B.train(noisy, feats, ["y"], B.BoostConfig(rounds=3, depth=3, patience=None))["y"]
    rows = noisy.select("company", "year", *feats).coalesce(1)
    whole = {r["company"]: r["contributions"] for r in AT.attributions(rows, m, feats, "y").collect()}
    monkeypatch.setattr(AT, "EXPLAINED_ROWS", 50, raising=False)
    wide = AT.attributions(rows, m, feats, "y")
    assert {r["company"]: r["contributions"] for r in wide.collect()} == whole and len(whole) == 400
    assert most_in_a_task(wide) <= 60


def test_rows_of_a_few_blocks_are_grown_without_passes(spark, monkeypatch):
    got, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda rdd: got.append(1) or collect(rdd))
    df = spark.range(40_000).select(
        F.concat(F.lit("c"), "id").alias("company"), F.lit(2000).alias("year"), (F.col("id") % 97).cast("double").alias("f0"),
        (F.col("id") % 11).cast("double").alias("f1"), (F.col("id") % 97 * 2.0 - F.col("id") % 11).alias("y"),
        F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"))
    m = B.train(df, ["f0", "f1"], ["y"], B.BoostConfig(rounds=3, depth=3))["y"]
    assert len(got) == 1 and len(m.trees) == 3 and 25_000 < m.trees[0].rows[0] < 26_200


def test_a_pass_takes_errors_and_the_next_first_level(noisy, monkeypatch):
    cfg, feats = B.BoostConfig(rounds=4, depth=3, bins=16), [f"f{j}" for j in range(6)]
    one = B.train(noisy, feats, ["y"], cfg)["y"]
    got, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda rdd: got.append(1) or collect(rdd))
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)
    many = B.train(noisy, feats, ["y"], cfg)["y"]
    assert many.trees == one.trees and many.errors == one.errors
    assert len(got) == 4 * 3 + 1                                    # levels, and the last errors


def test_paired_and_single_columns_have_the_same_sums():
    rng = np.random.default_rng(3)
    x, rows = rng.integers(0, 5, (3, 900)).astype(np.uint8), np.arange(0, 900, 2)
    node, g = rng.integers(0, 3, len(rows)), rng.integers(-2 ** 30, 2 ** 30, len(rows)).astype(float)
    want = np.zeros((3, 3, 5, 2), np.int64)
    for c in range(3):
        np.add.at(want[:, c, :, 0], (node, x[c, rows]), g.astype(np.int64))
        np.add.at(want[:, c, :, 1], (node, x[c, rows]), 1)
    at = np.arange(3)
    assert (B._cell_sums(x, at, rows, node, g, 3, 5) == want).all()                              # 450 rows, 3 x 25 cells: pairs
    few = [B._cell_sums(x, at, rows[lo: lo + 150], node[lo: lo + 150], g[lo: lo + 150], 3, 5) for lo in (0, 150, 300)]
    assert (sum(few) == want).all()


def grown_tree(rng, depth, features, bins=7):
    t, at = B.Tree(), [(0, 0)]
    t.add(0.5, 1000)
    for node, d in at:
        if d < depth and (d < 2 or rng.random() < 0.8) and t.rows[node] > 1:
            n = int(rng.integers(1, t.rows[node]))
            t.feature[node], t.bin[node] = int(rng.integers(features)), int(rng.integers(bins))
            t.left[node], t.right[node] = t.add(float(rng.normal()), n), t.add(float(rng.normal()), t.rows[node] - n)
            at += [(t.left[node], d + 1), (t.right[node], d + 1)]
    return t


def walked(t, goes_right):
    node = 0
    while t.left[node] >= 0:
        node = t.right[node] if goes_right(t.feature[node], t.bin[node]) else t.left[node]
    return node


@pytest.mark.parametrize("depth", [0, 1, 6, 9])
def test_paths_end_where_a_walk_ends(depth):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 8, (3, 203)).astype(np.uint8)
    for t in (grown_tree(rng, depth, 3) for _ in range(4)):
        assert t.leaves_of(x).tolist() == [walked(t, lambda f, b: r[f] > b) for r in x.T]


def test_batches_are_scored_together_and_each_split_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    cuts = [sorted(rng.normal(size=7)) for _ in range(3)]
    m = B.Boosted("y", ["f0", "f1", "f2"], cuts, 0.25, [grown_tree(rng, 5, 3) for _ in range(20)], [], 20)
    x = np.vstack([rng.normal(size=(398, 3)), [[np.nan] * 3, [cuts[j][3] for j in range(3)]]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, f0 double, f1 double, f2 double").coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "90")
    try:
        got = [r["predicted_y"] for r in B.arrow_scorer({"y": m})(df, ["y"]).orderBy("i").collect()]
    finally:
        spark.conf.set(key, before)

    def total(row):
        out = m.base
        for t in m.trees:
            out += t.value[walked(t, lambda f, b: not row[f] <= cuts[f][b])]
        return out
    assert got == [total(r) for r in x]
    compared, pack = [], np.packbits
    monkeypatch.setattr(np, "packbits", lambda a: compared.append(1) or pack(a))
    splits = {(f, b) for t in m.trees for f, b in zip(t.feature, t.bin) if f >= 0}
    number = {s: i for i, s in enumerate(sorted(splits))}
    trees = [(t.left, t.right, [number.get((f, b), -1) for f, b in zip(t.feature, t.bin)], np.array(t.value)[B.path_ends(t.left, t.right)])
             for t in m.trees]
    scores = B._scored(np.ascontiguousarray(x.T), [(f, [cuts[f][b] for g, b in sorted(splits) if g == f]) for f in range(3)], [(m.base, trees)])
    assert scores[:, 0].tolist() == got and len(compared) == len(splits) < sum(len(t.left) // 2 for t in m.trees)


@pytest.mark.parametrize("depth", [0, 1, 4, 6])
def test_contributions_are_looked_up(depth, monkeypatch):
    rng = np.random.default_rng(depth)
    m = B.Boosted("y", [f"f{j}" for j in range(4)], [sorted(rng.normal(size=7)) for _ in range(4)], 0.0,
                  [grown_tree(rng, depth, 4) for _ in range(5)], [], 5)
    x, want = np.vstack([rng.normal(size=(300, 4)), [[c[2] for c in m.cuts], [np.nan] * 4]]), np.zeros((302, 4))
    trees = AT.model_trees(m)
    for t in trees:
        AT.tree_shap(x, t, want)
    monkeypatch.setattr(AT, "tree_shap", None)                      # no tree is walked row by row
    assert np.allclose(AT.explain_batch(x, trees), want, atol=1e-12)
    assert np.allclose(AT.explain_batch(x, trees), want, atol=1e-12)        # with the tables at hand


def test_deep_trees_are_walked():
    rng = np.random.default_rng(9)
    t = grown_tree(rng, 10, 4)
    m = B.Boosted("y", list("abcd"), [sorted(rng.normal(size=7)) for _ in range(4)], 0.0, [t], [], 1)
    x, want = rng.normal(size=(50, 4)), np.zeros((50, 4))
    AT.tree_shap(x, AT.model_trees(m)[0], want)
    assert np.allclose(AT.explain_batch(x, AT.model_trees(m)), want) and AT.shap_tables(AT.model_trees(m)[0]) is None
