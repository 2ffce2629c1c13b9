"""The whole analysis of a panel that a user reads from a file."""

import os

from pyspark.sql import functions as F

from ledgerlens.functions import stats
from ledgerlens.operators.boosting import BoostConfig
from ledgerlens.plans import catalog
from ledgerlens.plans.analysis import PanelAnalysis
from ledgerlens.sources.panel import read_panel
from tests.conftest import SF_SMALL


def test_a_csv_panel_through_all_layers(spark, tmp_path):
    path = os.path.join(str(tmp_path), "panel")
    catalog.raw(spark, SF_SMALL).write.option("header", True).csv(path)
    panel = read_panel(spark, path)
    n = panel.rows.count()
    assert n == catalog.raw(spark, SF_SMALL).count() and panel.rejected.isEmpty() and panel.repeated.isEmpty()
    a = PanelAnalysis(panel.rows, config=BoostConfig(rounds=4, depth=3), n_sims=10, split={"train_end": 1999, "test_start": 2001})
    firms = panel.rows.select("company").distinct().count()
    assert a.regimes.count() == n and a.regimes.where("regime IS NULL OR regime_name IS NULL").isEmpty()
    assert a.scored.where("predicted_roa IS NULL").isEmpty() and a.predictions.count() == 2 * 7 * firms
    assert a.risk.count() == a.ranking.count() == 2 * firms and a.bootstrap.count() == 20
    assert a.risk.where("risk_score < 0 OR risk_score > 100").isEmpty()
    row = a.kpis.first()
    assert row["n_firms"] == firms and row["top_driver"] in a.feature_names
    assert a.sectors.agg(F.sum("firm_count")).first()[0] == 2 * firms


def test_fills_do_not_depend_on_the_size_bound(spark, monkeypatch):
    df = spark.createDataFrame([(f"s{i % 3}", 2000 + i % 2, None if i % 4 == 0 else float(i * i % 37), None if i % 7 == 0 else i / 3)
                                for i in range(400)], "sector string, year int, a double, b double")
    few = [stats.fill_with_medians(df, k, ["a", "b"], hot=True).orderBy("sector", "year", "a", "b").collect() for k in ([], ["sector", "year"])]
    monkeypatch.setattr(stats, "LEAF_ROWS", 40)
    assert few == [stats.fill_with_medians(df, k, ["a", "b"], hot=True).orderBy("sector", "year", "a", "b").collect() for k in ([], ["sector", "year"])]
