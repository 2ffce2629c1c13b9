"""Models (C10, C11, H7, I9, I12-I17, E8).

The boosted trees are in :mod:`.boosting`; evaluation metrics are closed-form
aggregates per (target, split) in one pass.  A fixed linear
scorer (``scenarios.LINEAR_SCORER``) gives SQL-checkable predictions for the
same metric, scoring and scenario operators.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.stats import fill_with_medians, pair_corr
from .registry import describe

# Base ratios, macro columns and targets of the analysed model.
LAYER1_RATIOS = ["gross_margin", "operating_margin", "debt_ratio", "debt_to_equity",
                 "equity_ratio", "current_ratio", "quick_ratio", "asset_turnover",
                 "cfo_to_assets", "cfo_to_sales", "capex_to_sales", "firm_size",
                 "roa_volatility", "cash_ratio"]
MACRO_BASE = ["inflation", "fed_rate", "gdp_growth", "sp500", "sector_benchmark"]
TARGETS = ["roa", "profit_margin"]


# Registry families whose columns are model inputs.
MODEL_FAMILIES = ("lag", "trend", "rolling", "interaction", "three_way", "regime_dummy", "regime_product")
# Single columns that are model inputs beside those families.
MODEL_STATE = ["stress_intensity", "regime", "regime_confidence"]
# Families whose columns hold the current value of their source variable.
CURRENT_VALUE_FAMILIES = ("trend", "rolling", "regime_product")


def feature_columns(df, targets=TARGETS, mode: str = "clean") -> list[str]:
    """The model's features, a registry query in sorted order.  Mode
    ``clean`` leaves out columns that hold a target's current value (its
    rolling mean, trend and regime products); ``reference`` keeps them as the
    analysed pipeline does.  ``df`` is a DataFrame or a list of names."""
    names = df if isinstance(df, (list, tuple)) else df.columns
    single = {*LAYER1_RATIOS, *MACRO_BASE, *MODEL_STATE} - {*targets, "roe"}

    def wanted(name: str) -> bool:
        entry = describe(name)
        if entry is None or entry.family not in MODEL_FAMILIES:
            return name in single
        return mode != "clean" or entry.family not in CURRENT_VALUE_FAMILIES or entry.source not in targets

    return sorted({n for n in names if wanted(n)})


def split_col(time_col: str = "year", train_end: int = 1999, test_start: int = 2001) -> Column:
    """H7: temporal split: train <= train_end, test >= test_start, else validation."""
    y = F.col(time_col)
    return F.when(y <= train_end, "train").when(y >= test_start, "test").otherwise("val")


def median_year_split(df: DataFrame, time_col: str = "year") -> DataFrame:
    """H7 for the fallback trainer: rows before the middle one of the distinct
    years are ``train``, the others ``test``; ``split_year`` is that year.  The
    years come as one small array in a scalar subquery."""
    years = df.agg(F.array_sort(F.collect_set(time_col)).alias("y"))       # one value a year
    middle = years.select(F.try_element_at("y", (F.size("y") / 2).cast("int") + 1)).scalar()
    return df.withColumn("split_year", middle).withColumn(
        "split", F.when(F.col(time_col) < F.col("split_year"), "train").otherwise("test"))


# Columns that the fallback trainer never takes as features.
FALLBACK_EXCLUDED = ["company", "year", "sector", "roa", "roe", "profit_margin", "regime_gmm", "regime_name", "gdp_growth"]


def fallback_features(df: DataFrame) -> list[str]:
    """Every numeric column but identifiers, targets and predictions."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in FALLBACK_EXCLUDED
            and "predicted" not in f.name and "error" not in f.name]


def fallback_matrix(df: DataFrame, targets=TARGETS) -> DataFrame:
    """Rows with all targets, features median-filled, median-year split."""
    known = df.dropna(subset=list(targets))
    return median_year_split(fill_with_medians(known, [], fallback_features(known)))


def model_matrix(df: DataFrame, features: list[str], targets=TARGETS, **split) -> DataFrame:
    """Rows with all targets, features median-filled (exact global
    medians), plus the split column."""
    m = df.dropna(subset=list(targets))
    m = fill_with_medians(m, [], [c for c in features if c in m.columns])
    return m.withColumn("split", split_col(**split))


def score_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """C11: absent feature columns added as 0, nulls to 0."""
    missing = {c: F.lit(0.0) for c in features if c not in df.columns}
    return df.withColumns(missing).na.fill(0.0, subset=features)


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(
        df.withColumns({c: F.col(c).cast("double") for c in features}))


def train_linear(matrix: DataFrame, features: list[str], target: str):
    """Ordinary least squares baseline on the training split."""
    data = assemble(matrix.where(F.col("split") == "train"), features)
    return LinearRegression(featuresCol="features", labelCol=target, regParam=0.0,
                            elasticNetParam=0.0, solver="normal").fit(data)


def predict(model, df: DataFrame, features: list[str], out_col: str) -> DataFrame:
    return model.transform(assemble(df, features)).withColumnRenamed("prediction", out_col).drop("features")


def metrics(pred: DataFrame, target: str, pred_col: str, group_cols=("split",)) -> DataFrame:
    """R2, RMSE, MAE per group in one aggregate pass."""
    y, p = F.col(target), F.col(pred_col)
    a = pred.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((y - p) * (y - p)).alias("sse"), F.var_pop(y).alias("vy"),
        F.avg(F.abs(y - p)).alias("mae"))
    return a.select(F.lit(target).alias("target"), *group_cols, "n",
                    (1 - F.try_divide(F.col("sse"), F.col("vy") * F.col("n"))).alias("r2"),
                    F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae")


def r2_status(r2) -> Column:
    """EXCELLENT > .9, GOOD > .7, else MODERATE."""
    return F.when(r2 > 0.9, "EXCELLENT").when(r2 > 0.7, "GOOD").otherwise("MODERATE")


def overfit_report(m: DataFrame) -> DataFrame:
    """Train-test R2 gap per target, flag when above 0.1."""
    w = m.groupBy("target").agg(
        F.max(F.when(F.col("split") == "train", F.col("r2"))).alias("train_r2"),
        F.max(F.when(F.col("split") == "test", F.col("r2"))).alias("test_r2"))
    gap = F.col("train_r2") - F.col("test_r2")
    return w.select("target", "train_r2", "test_r2", gap.alias("gap"),
                    F.when(gap > 0.1, "Possible overfitting").otherwise("Good generalization").alias("flag"),
                    r2_status(F.col("test_r2")).alias("status"))


def importance_table(model, spark) -> DataFrame:
    """The features' shares of the mean split gain as a table."""
    return spark.createDataFrame([(model.target, *r) for r in model.importance()], "target string, feature string, importance double")


def with_errors(df: DataFrame, target: str, pred_col: str) -> DataFrame:
    """Error and error % = error / max(|actual|, .01) * 100."""
    err = F.col(target) - F.col(pred_col)
    return df.withColumns({f"{target}_error": err,
                           f"{target}_error_pct": err / F.greatest(F.abs(F.col(target)), F.lit(0.01)) * 100})


def error_corr(df: DataFrame, targets=TARGETS) -> DataFrame:
    """Pairwise correlation of the targets' prediction errors (long form),
    pairs of different errors above 0.5 marked."""
    cols = [f"{t}_error" for t in targets]
    one = df.agg(*[pair_corr(a, b).alias(f"{a}|{b}") for a in cols for b in cols])
    long = one.unpivot([], [f"{a}|{b}" for a in cols for b in cols], "pair", "corr")
    a, b = F.split("pair", r"\|").getItem(0), F.split("pair", r"\|").getItem(1)
    return long.select(a.alias("error_a"), b.alias("error_b"), "corr",
                       (F.coalesce(F.abs("corr") > 0.5, F.lit(False)) & (a != b)).alias("strong"))
