"""Exact statistics and expression helpers against numpy/pandas twins."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import clip, flag, safe_div
from ledgerlens.functions.stats import hot_median_by, hot_quantiles_by, median_by
from ledgerlens.operators.clean import interpolate


def _frame(spark, seed=7, n=3000):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "g": rng.integers(0, 5, n),
        "a": rng.normal(0, 1e3, n),
        "b": rng.integers(-2, 3, n).astype(float),          # heavy ties
        "c": np.exp(rng.normal(0, 5, n)) * rng.choice([-1, 1], n),  # wide magnitudes
    })
    pdf.loc[rng.random(n) < 0.2, "a"] = np.nan
    pdf.loc[pdf.g == 4, "c"] = np.nan                         # an all-null group
    return pdf, spark.createDataFrame(pdf)


def test_hot_median_matches_pandas(spark):
    pdf, df = _frame(spark)
    got = hot_median_by(df, ["g"], ["a", "b", "c"], "").toPandas().set_index("g").sort_index()
    exp = pdf.groupby("g")[["a", "b", "c"]].median()
    pd.testing.assert_frame_equal(got[["a", "b", "c"]], exp, check_names=False, check_index_type=False,
                                  rtol=0, atol=0)


def test_hot_median_global_and_bounded_agree(spark):
    pdf, df = _frame(spark, seed=11)
    g = hot_median_by(df, [], ["a", "c"], "").first()
    assert g["a"] == pdf["a"].median()
    assert g["c"] == pdf["c"].median()
    b = median_by(df, ["g"], ["a"], "").toPandas().set_index("g").sort_index()["a"]
    h = hot_median_by(df, ["g"], ["a"], "").toPandas().set_index("g").sort_index()["a"]
    assert np.allclose(b.values, h.values, rtol=0, atol=0)


def test_hot_quantiles_match_numpy(spark):
    pdf, df = _frame(spark, seed=3)
    ps = [0.025, 0.05, 0.25, 0.75, 0.95, 0.975]
    q = hot_quantiles_by(df, ["g"], ["a"], ps).toPandas().set_index("g").sort_index()
    for g, part in pdf.groupby("g"):
        exp = np.percentile(part["a"].dropna(), [p * 100 for p in ps])
        got = q.loc[g, [f"q_{i}" for i in range(len(ps))]].to_numpy(dtype=float)
        assert np.allclose(got, exp, rtol=1e-12, atol=1e-9)


def test_interpolation_edges(spark):
    rows = [("x", 1, None), ("x", 2, 2.0), ("x", 3, None), ("x", 4, None), ("x", 5, 8.0), ("x", 6, None),
            ("y", 1, None), ("y", 2, None)]
    df = spark.createDataFrame(rows, "company string, year int, v double")
    out = {(r.company, r.year): r.v for r in interpolate(df, ["v"]).collect()}
    assert [out[("x", y)] for y in range(1, 7)] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]
    assert out[("y", 1)] is None and out[("y", 2)] is None


def test_interpolation_matches_pandas(spark):
    rng = np.random.default_rng(5)
    recs = []
    for c in range(30):
        vals = rng.normal(0, 10, 9)
        vals[rng.random(9) < 0.4] = np.nan
        for y, v in enumerate(vals):
            recs.append((f"c{c}", 2000 + y, None if np.isnan(v) else float(v)))
    pdf = pd.DataFrame(recs, columns=["company", "year", "v"])
    exp = pdf.groupby("company")["v"].transform(lambda s: s.interpolate(method="linear", limit_direction="both"))
    got = interpolate(spark.createDataFrame(pdf), ["v"]).toPandas().sort_values(["company", "year"])
    exp = exp.loc[got.index] if False else pdf.assign(v=exp).sort_values(["company", "year"])["v"]
    assert np.allclose(got["v"].to_numpy(dtype=float), exp.to_numpy(dtype=float), equal_nan=True)


def test_null_safe_helpers(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, 0.0), (-3.0, 2.0)], "x double, y double")
    r = df.select(clip("x", lower=0.0, upper=1.0).alias("c"), safe_div("x", "y").alias("d"),
                  flag(F.col("x") > 0).alias("f")).collect()
    assert [x.c for x in r] == [None, 1.0, 0.0]
    assert [x.d for x in r] == [None, None, -1.5]
    assert [x.f for x in r] == [0, 1, 0]


def test_drop_columns_and_missing_pairs(spark):
    from ledgerlens.operators import quality as Q
    from ledgerlens.operators.clean import drop_columns
    df = spark.createDataFrame([("a", 2000, 1.0, 9.0), ("a", 2002, 2.0, 9.0), ("b", 2001, 3.0, 9.0)],
                               "company string, year int, v double, other_financing_activities double")
    assert "other_financing_activities" not in drop_columns(df).columns
    got = sorted(tuple(r) for r in Q.missing_pairs(df).collect())
    brute = sorted((c, y) for c in ("a", "b") for y in (2000, 2001, 2002)
                   if (c, y) not in {("a", 2000), ("a", 2002), ("b", 2001)})
    assert got == brute


def test_feature_modes():
    from ledgerlens.operators.models import feature_columns
    names = ["roa", "profit_margin", "roa_lag1", "roa_rolling3", "roa_trend", "debt_ratio",
             "roa_x_regime_0", "debt_ratio_x_regime_0", "inflation", "regime_0_dummy"]
    clean = feature_columns(names)
    ref = feature_columns(names, mode="reference")
    assert "roa" not in clean and "profit_margin" not in clean
    assert {"roa_rolling3", "roa_trend", "roa_x_regime_0"} <= set(ref)
    assert not {"roa_rolling3", "roa_trend", "roa_x_regime_0"} & set(clean)
    assert clean == sorted(clean)


def test_hot_quantiles_cut_crowded_buckets(spark, monkeypatch):
    from ledgerlens.functions import stats
    monkeypatch.setattr(stats, "LEAF_ROWS", 500)
    rng = np.random.default_rng(9)
    n = 40_000
    pdf = pd.DataFrame({"g": ["hot"] * (n - 7) + ["b"] * 7,
                        "near": 0.05 + rng.random(n) * 1e-6,          # one first bucket
                        "tiny": rng.random(n) * 2e-4,
                        "tied": np.where(rng.random(n) < 0.9, 3.0, rng.normal(0, 1, n)),
                        "wide": rng.normal(0, 1, n) * 10.0 ** rng.integers(-300, 300, n)})
    pdf.loc[::11, "near"] = np.nan
    df = spark.createDataFrame(pdf)
    cols, ps = ["near", "tiny", "tied", "wide"], [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.col): list(r)[2:] for r in hot_quantiles_by(df, ["g"], cols, ps).collect()}
    for g, part in pdf.groupby("g"):
        for c in cols:
            assert np.allclose(got[g, c], part[c].quantile(ps).to_numpy(), rtol=1e-12, atol=0)


def test_cut_lineage_scans_prune_and_push(spark):
    from ledgerlens.session import cut_lineage
    df = spark.range(10).selectExpr("id AS year", "id * 2 AS a", "id * 3 AS b")
    cut = cut_lineage(df).where("year = 3").select("a")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<year:bigint,a:bigint>" in plan and "EqualTo(year,3)" in plan
    assert [r.a for r in cut.collect()] == [6]
    assert cut_lineage(df.limit(0)).count() == 0
