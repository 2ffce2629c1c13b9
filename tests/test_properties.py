"""Properties for what SQL cannot check: attribution local accuracy, draw
reproducibility, ranking, clustering outputs, score ranges."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import attribution as AT
from ledgerlens.operators import boosting as BO
from ledgerlens.operators import regimes as R
from ledgerlens.operators import risk as RK
from ledgerlens.operators import scenarios as S
from ledgerlens.plans import catalog
from tests.conftest import SF_SMALL


def test_treeshap_local_accuracy(spark):
    rng = np.random.default_rng(0)
    n = 300
    X = rng.normal(size=(n, 5))
    y = X[:, 0] * 2 + np.where(X[:, 1] > 0, 1.0, -1.0) * X[:, 2] + rng.normal(0, 0.1, n)
    pdf = pd.DataFrame(X, columns=[f"f{i}" for i in range(5)]).assign(
        y=y, company=[f"c{i}" for i in range(n)], year=2000, split="train")
    df = spark.createDataFrame(pdf)
    feats = [f"f{i}" for i in range(5)]
    model = BO.train(df, feats, ["y"], BO.BoostConfig(rounds=15, depth=4, rate=0.3))["y"]
    w = AT.attributions(df, model, feats, "y").toPandas()
    pred = BO.arrow_scorer({"y": model})(df, ["y"]).select("company", F.col("predicted_y").alias("p")).toPandas()
    m = w.merge(pred, on="company")
    assert np.abs(m["prediction"] - m["p"]).max() < 1e-9
    contrib = np.vstack(m["contributions"].to_numpy())
    assert np.allclose(contrib.sum(axis=1) + m["base_value"], m["p"], atol=1e-9)
    # a feature the model never splits on gets zero attribution
    unused = [i for i, (_, share) in enumerate(model.importance()) if share == 0]
    for i in unused:
        assert np.allclose(contrib[:, i], 0.0)


def test_draw_table_independent_of_partitioning(spark):
    p = catalog.l2(spark, SF_SMALL)
    a = S.draw_table(p, 50).orderBy("sim_id").collect()
    b = S.draw_table(p.repartition(7), 50).orderBy("sim_id").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    years = {r.year for r in p.select("year").distinct().collect()}
    assert len(a) == 50 and years


def test_draws_are_independent(spark):
    p = spark.createDataFrame([(f"c{i}", 1995 + i % 7, float(i % 7), float(i % 7), float(i % 7)) for i in range(70)],
                              "company string, year int, inflation double, fed_rate double, gdp_growth double")
    names, n = list(S.NOISE_SD), 20_000
    zero = p.select("company", "year", *[F.lit(0.0).alias(v) for v in names])
    noise = S.draw_table(zero, n).orderBy("sim_id").select(*names).toPandas().to_numpy()
    picked = S.draw_table(p, n).orderBy("sim_id").select(*names).toPandas().to_numpy() - noise
    assert np.allclose(picked, np.rint(picked), atol=1e-9)
    # independent picks give about 269 of the 343 year triples in 500 draws
    assert len({tuple(r) for r in np.rint(picked[:500])}) >= 220
    assert np.abs(np.bincount(np.rint(picked).astype(int).ravel(), minlength=7) / (3 * n) - 1 / 7).max() < 0.01
    noise = noise / np.array(list(S.NOISE_SD.values()))
    four_sigma = 4 / np.sqrt(n)
    assert (np.abs(noise.mean(axis=0)) < four_sigma).all()
    assert (np.abs(noise.std(axis=0) - 1) < four_sigma).all()
    assert (np.abs(np.corrcoef(np.hstack([picked, noise]).T) - np.eye(6)) < four_sigma).all()


def test_draws_of_an_empty_panel_are_null(spark):
    p = spark.createDataFrame([], "company string, year int, inflation double, fed_rate double, gdp_growth double")
    rows = S.draw_table(p, 3).collect()
    assert len(rows) == 3 and all(r[v] is None for r in rows for v in S.NOISE_SD)


def test_base_scenario_equals_scoring_the_unshifted_rows(spark):
    panel = catalog.l2(spark, SF_SMALL)
    base = S.baseline_macros(panel)
    latest = catalog._latest(spark, SF_SMALL)
    still = S.update_macro_terms(latest, *[F.lit(base[v]) for v in ("inflation", "fed_rate", "gdp_growth")])
    for t in catalog.TARGETS:
        alone = still.select("company", S.linear_score(t).alias("p"))
        pred = catalog._pred(spark, SF_SMALL).where((F.col("target") == t) & (F.col("scenario") == "BASE"))
        gap = pred.join(alone, "company").select(F.max(F.abs(F.col("predicted") - F.col("p"))), F.count(F.lit(1))).first()
        assert gap[0] < 1e-12 and gap[1] == latest.count()
    vals = dict((k, (i, r, g)) for k, _n, i, r, g in S.scenario_values(base))
    assert vals["BASE"] == (base["inflation"], base["fed_rate"], base["gdp_growth"])


def test_scenario_modes(spark):
    df = spark.createDataFrame([("a", 5.0, 4.0, 2.0, 0.5, -3.0, 0.2, 9.0, 9.0, 9.0, 0)],
                               "company string, inflation double, fed_rate double, gdp_growth double, debt_ratio double, "
                               "stock_return_company double, cash_ratio double, perfect_storm_risk double, "
                               "distress_signal double, stress_intensity double, recession int")
    shock = [F.lit(10.0), F.lit(8.0), F.lit(-2.0)]
    ref = S.update_macro_terms(df, *shock).first()
    full = S.update_macro_terms(df, *shock, mode="full").first()
    assert (ref.inflation, ref.inflation_debt_interaction) == (10.0, 5.0)
    assert (ref.perfect_storm_risk, ref.distress_signal, ref.recession) == (9.0, 9.0, 0)
    assert abs(ref.stress_intensity - 60.0) < 1e-9
    assert (full.perfect_storm_risk, full.distress_signal, full.recession) == (40.0, 1.5, 1)
    assert abs(full.cash_rate_interaction - 1.6) < 1e-12 and abs(full.stress_intensity - 85.0) < 1e-9


def test_risk_scores_in_range(spark):
    risk = catalog._risk(spark, SF_SMALL)
    r = risk.agg(F.min("risk_score"), F.max("risk_score"), F.count(F.lit(1))).first()
    assert 0 <= r[0] <= r[1] <= 100 and r[2] > 0


def test_global_rank_matches_row_number(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"company": [f"c{i % 37}" for i in range(500)],
                        "target": [["ROA", "PM"][i % 2] for i in range(500)],
                        "risk_score": np.round(rng.uniform(0, 100, 500), 0)})
    pdf = pdf.drop_duplicates(["company", "target"])
    df = spark.createDataFrame(pdf).repartition(5)
    got = RK.global_rank(df, [F.desc("risk_score"), "company", "target"]).select(
        "company", "target", "rank")
    exp = df.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("risk_score"), "company", "target")))
    j = got.join(exp, ["company", "target"])
    assert j.where(F.col("rank") != F.col("rn")).count() == 0
    assert j.count() == len(pdf)


def test_clusters_partition_and_probabilities(spark):
    t = R.standardize(catalog.months_c(spark, SF_SMALL), catalog._C_VARS)
    km = R.fit_kmeans(t, catalog._C_Z, 3, "period")
    labels = {r.regime_kmeans for r in km.select("regime_kmeans").distinct().collect()}
    assert labels <= {0, 1, 2} and km.count() == t.count()
    g = R.fit_gmm(t, catalog._C_Z, 2)
    s = g.select((F.col("regime_prob_0") + F.col("regime_prob_1")).alias("s"), "regime_confidence").collect()
    assert all(abs(r.s - 1) < 1e-9 and 0.5 - 1e-9 <= r.regime_confidence <= 1 + 1e-9 for r in s)


def test_choose_k_rule(spark):
    sweep = spark.createDataFrame([(1, 100.0, None), (2, 40.0, None), (3, 30.0, None), (4, 25.0, None)],
                                  "k int, inertia double, gmm_bic double")
    assert R.choose_k(sweep).first()["k"] == 2
    sweep2 = spark.createDataFrame([(1, 100.0, None), (2, 95.0, None), (3, 20.0, None)],
                                   "k int, inertia double, gmm_bic double")
    assert R.choose_k(sweep2).first()["k"] == 3
    sweep3 = spark.createDataFrame([(1, 100.0, None), (2, 95.0, None)], "k int, inertia double, gmm_bic double")
    assert R.choose_k(sweep3).first()["k"] == 3
