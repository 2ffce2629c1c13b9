"""The layers as one analysis of any panel.

``PanelAnalysis(panel)`` takes a company x year panel (a DataFrame with the
columns of ``sources.panel.PANEL`` that it has, as ``sources.panel.read_panel``
gives) and makes each layer when it is first asked for::

    a = PanelAnalysis(read_panel(spark, "panel.csv").rows)
    a.cleaned, a.features, a.macro        # layers 0 to 2
    a.regimes                             # layer 3: labels, names, products
    a.models, a.scored                    # layer 4: boosted trees
    a.predictions, a.bootstrap            # layer 5: scenarios and draws
    a.drivers                             # layer 6: attributions
    a.risk, a.warnings, a.ranking, a.sectors, a.kpis     # layer 7

Layers are written once and scanned again, so that a later one does not
compute an earlier one anew.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution, boosting, clean, features, models, regimes, risk, scenarios
from ..session import cut_lineage

# Firm columns that scenarios read beside the model's features.
FIRM_COLUMNS = ("sector", "inflation", "fed_rate", "gdp_growth", "gdp", "debt_ratio", "debt_to_equity", "current_ratio",
                "gross_margin", "asset_turnover", "profit_margin", "firm_size", "quick_ratio", "roa_volatility")
# Ratios that are multiplied by the regime dummies.
PRODUCT_RATIOS = ["roa", "roe", "debt_ratio", "profit_margin", "current_ratio", "asset_turnover"]


def label_regimes(panel: DataFrame, time_col: str = "year") -> DataFrame:
    """Layer 3: k-means and mixture regimes of the panel's period table joined
    back by year, named by rules, with regime dummies and products (D20)."""
    macros = regimes.macro_columns(panel)
    t = cut_lineage(regimes.standardize(regimes.period_table(panel, macros, time_col), macros))
    z = [f"z_{c}" for c in macros]
    k = int(regimes.choose_k(regimes.kmeans_sweep(t, z, 6, time_col)).first()["k"])
    km = cut_lineage(regimes.fit_kmeans(t, z, k, time_col)).withColumnRenamed("regime_kmeans", "regime")
    mixture = regimes.fit_gmm(t, z, k).select(time_col, "regime_gmm", "regime_confidence", "low_confidence")
    profile = regimes.cluster_profile(km, "regime", macros, time_col)
    if "regime_name" not in profile.columns:
        profile = profile.withColumn("regime_name", F.lit(None).cast("string"))
    labels = (km.select(time_col, "regime").join(mixture, time_col, "left")
              .join(profile.select("regime", "regime_name"), "regime", "left"))
    out = regimes.regime_products(regimes.label_panel(panel, labels, time_col), "regime", k, PRODUCT_RATIOS, features.THREE_WAY)
    return out.withColumn("regime_confidence", F.coalesce("regime_confidence", F.lit(0.0)))


class PanelAnalysis:
    """All layers of one panel; see the module."""

    def __init__(self, panel: DataFrame, targets=("roa", "profit_margin"), config: boosting.BoostConfig = boosting.BoostConfig(),
                 n_sims: int = 500, split: dict | None = None, feature_mode: str = "clean"):
        self.panel, self.targets, self.config, self.n_sims = panel, list(targets), config, n_sims
        self.split, self.feature_mode = split or {}, feature_mode

    @cached_property
    def cleaned(self) -> DataFrame:
        return clean.clean_panel(self.panel)

    @cached_property
    def features(self) -> DataFrame:
        return features.layer1(self.cleaned)

    @cached_property
    def macro(self) -> DataFrame:
        return cut_lineage(features.layer2(self.features))

    @cached_property
    def regimes(self) -> DataFrame:
        return cut_lineage(label_regimes(self.macro))

    @cached_property
    def feature_names(self) -> list[str]:
        return models.feature_columns(self.regimes, self.targets, mode=self.feature_mode)

    @cached_property
    def matrix(self) -> DataFrame:
        return cut_lineage(models.model_matrix(self.regimes, self.feature_names, self.targets, **self.split))

    @cached_property
    def models(self) -> dict[str, boosting.Boosted]:
        return boosting.train(self.matrix, self.feature_names, self.targets, self.config)

    @cached_property
    def scorer(self):
        return boosting.arrow_scorer(self.models)

    @cached_property
    def scored(self) -> DataFrame:
        return self.scorer(self.regimes, self.targets)

    @cached_property
    def latest(self) -> DataFrame:
        need = [c for c in self.regimes.columns if c in {*FIRM_COLUMNS, *self.feature_names} - {"company"}]
        return scenarios.latest_per_company(self.regimes, need)

    @cached_property
    def predictions(self) -> DataFrame:
        return cut_lineage(scenarios.score_scenarios(self.latest, scenarios.baseline_macros(self.regimes), self.targets, self.scorer))

    @cached_property
    def compared(self) -> DataFrame:
        return scenarios.base_vs_scenarios(self.predictions)

    @cached_property
    def bootstrap(self) -> DataFrame:
        draws = cut_lineage(scenarios.draw_table(self.macro, self.n_sims))
        return cut_lineage(scenarios.bootstrap_means(self.latest, draws, self.targets, self.scorer))

    @cached_property
    def attributions(self) -> DataFrame:
        """Contributions of every row to the first target's prediction."""
        t = self.targets[0]
        return cut_lineage(attribution.attributions(
            models.score_matrix(self.regimes, self.feature_names), self.models[t], self.feature_names, t))

    @cached_property
    def drivers(self) -> DataFrame:
        return attribution.risk_drivers(self.attributions, self.feature_names)

    @cached_property
    def risk(self) -> DataFrame:
        return cut_lineage(risk.risk_scores(self.compared, risk.roa_history(self.macro)))

    @cached_property
    def warnings(self) -> DataFrame:
        return risk.by_drop(risk.warnings(self.compared))

    @cached_property
    def ranking(self) -> DataFrame:
        return risk.risk_ranking(self.risk)

    @cached_property
    def sectors(self) -> DataFrame:
        return risk.sector_summary(self.risk)

    @cached_property
    def kpis(self) -> DataFrame:
        return risk.kpi_row(self.risk, risk.warnings(self.compared), self.drivers)
