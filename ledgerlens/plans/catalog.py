"""Query catalogue: one Spark query per operator id of the inventory, each
with its DuckDB twin where SQL can express it.

Each Spark entry takes (spark, sf_dir) and returns a DataFrame.  Layer panels
are built once per (session, scale) and reused: they are reliable checkpoints,
so reuse also survives executor loss.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as CL
from ..operators import features as FE
from ..operators import quality as Q
from ..session import cut_lineage
from ..sources.panel import MEASURES, read_panel
from ..sources.fixtures import PANEL_A_MEASURES, PANEL_B_SQL, duckdb_sql, panel_a, panel_b
from . import oracle as O
from .analysis import PanelAnalysis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- layers --
_CACHE: dict[tuple, DataFrame] = {}


def _layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _CACHE:
        # raw is a scan + aggregate read once by cleaning; clean and l1 end in
        # projections over their own internal checkpoints; l2 ends in a
        # window and feeds many queries, so it is written as a checkpoint.
        if name == "raw":
            df = panel_a(spark, sf_dir)
        elif name == "clean":
            df = CL.clean_panel(_layer(spark, sf_dir, "raw"))
        elif name == "l1":
            df = FE.layer1(_layer(spark, sf_dir, "clean"))
        elif name == "l2":
            df = cut_lineage(FE.layer2(_layer(spark, sf_dir, "l1")))
        else:
            raise KeyError(name)
        _CACHE[key] = df
    return _CACHE[key]


def raw(spark, sf_dir):
    return _layer(spark, sf_dir, "raw")


def clean(spark, sf_dir):
    return _layer(spark, sf_dir, "clean")


def l1(spark, sf_dir):
    return _layer(spark, sf_dir, "l1")


def l2(spark, sf_dir):
    return _layer(spark, sf_dir, "l2")


def cols_sql(cols) -> str:
    return ", ".join(cols)


PB = "WITH pb AS (" + duckdb_sql(PANEL_B_SQL) + ")\n"
ALL_RAW = O.RAW_COLS

# ------------------------------------------------------- A: scan / sinks --


@query("a1_panel_scan", O.with_layers("raw", f"SELECT {cols_sql(ALL_RAW)} FROM raw"))
def a1_panel_scan(spark, sf_dir):
    """A1: typed scan of the company x year panel."""
    return panel_a(spark, sf_dir).select(*ALL_RAW)


@query("a2_layer_roundtrip", O.with_layers("clean", f"SELECT {cols_sql(ALL_RAW)} FROM clean"))
def a2_layer_roundtrip(spark, sf_dir):
    """A2: write the cleaned layer as parquet (partitioned by year) under the
    checkpoint folder and scan it back."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..sources.sinks import read_layer, write_layer
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/layers/clean-{uuid.uuid4().hex}"
    write_layer(clean(spark, sf_dir), path, partition_by="year")
    return read_layer(spark, path).select(*ALL_RAW)


@query("a2b_year_rewrite", O.with_layers(
    "clean", "SELECT company, year, CASE WHEN year = 2000 THEN net_sales * 2 ELSE net_sales END AS net_sales, total_assets FROM clean "
             "WHERE year IN (1999, 2000)"))
def a2b_year_rewrite(spark, sf_dir):
    """A2: one year of a partitioned layer written anew, the others left alone,
    two years scanned (pruned to their folders)."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..sources.sinks import read_layer, rewrite_partitions, write_layer
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/layers/years-{uuid.uuid4().hex}"
    layer = clean(spark, sf_dir).select("company", "year", "net_sales", "total_assets")
    write_layer(layer, path, partition_by="year")
    rewrite_partitions(layer.where("year = 2000").withColumn("net_sales", F.col("net_sales") * 2), path, "year")
    return read_layer(spark, path, "year IN (1999, 2000)").select("company", "year", "net_sales", "total_assets")


_DIRTY = ("cash", "stock_price", "net_income")


def _dirty_panel(spark, sf_dir):
    """The raw panel as a user's CSV: NaN and infinities in three columns, text
    in the year of firms ending in 9, and a poorer second row for those ending in 3."""
    import uuid
    from ..session import ensure_checkpoint_dir
    p = raw(spark, sf_dir).select(*ALL_RAW, F.lit("kept out").alias("remark"))
    last = F.right("company", F.lit(1))
    texts = {c: F.col(c).cast("string") for c in p.columns}
    texts["cash"] = F.when(last == "1", "NaN").otherwise(texts["cash"])
    texts["stock_price"] = F.when(last == "2", "inf").otherwise(texts["stock_price"])
    texts["net_income"] = F.when(last == "4", "-inf").otherwise(texts["net_income"])
    texts["year"] = F.when(last == "9", F.concat(F.lit("year "), F.col("year").cast("string"))).otherwise(texts["year"])
    first = p.select(*[v.alias(c) for c, v in texts.items()])
    again = first.where(F.right("company", F.lit(1)) == "3").withColumns({c: F.lit(None).cast("string") for c in ("net_sales", "cash")})
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/csv/panel-{uuid.uuid4().hex}"
    first.unionByName(again).write.option("header", True).csv(path)
    return read_panel(spark, path)


_RIGHT = {"cash": "1", "stock_price": "2", "net_income": "4"}


@query("a1b_panel_reader", O.with_layers("raw", "SELECT " + ", ".join(
    f"CASE WHEN right(company, 1) = '{_RIGHT[c]}' THEN NULL ELSE {c} END AS {c}" if c in _RIGHT else c for c in ALL_RAW)
    + " FROM raw WHERE right(company, 1) <> '9'"))
def a1b_panel_reader(spark, sf_dir):
    """A CSV panel with NaN, infinities, broken lines and repeated keys, read."""
    return _dirty_panel(spark, sf_dir).rows.select(*ALL_RAW)


@query("a1c_panel_findings", O.with_layers(
    "raw", "SELECT 'rejected line' AS finding, count(*) AS n FROM raw WHERE right(company, 1) = '9' UNION ALL "
           "SELECT 'repeated key', count(*) FROM raw WHERE right(company, 1) = '3' UNION ALL SELECT 'missing column', 32"))
def a1c_panel_findings(spark, sf_dir):
    """A1: what the reader found: lines that do not parse, repeated keys,
    declared columns that the file lacks."""
    p = _dirty_panel(spark, sf_dir)
    return (p.rejected.agg(F.lit("rejected line").alias("finding"), F.count(F.lit(1)).alias("n"))
            .unionByName(p.repeated.agg(F.lit("repeated key").alias("finding"), F.count(F.lit(1)).alias("n")))
            .unionByName(spark.createDataFrame([("missing column", len(p.missing))], "finding string, n long")))


_PREVIEW = ["company", "year", "roa", "debt_ratio", "current_ratio", "asset_turnover",
            "firm_size", "roa_lag1", "roa_rolling3", "roa_trend"]


@query("a5_preview", O.with_layers("l1", f"SELECT {cols_sql(_PREVIEW)} FROM l1 ORDER BY company, year LIMIT 5"))
def a5_preview(spark, sf_dir):
    """A4/A5: first rows in (company, year) order (a top-k, not a full sort)."""
    return l1(spark, sf_dir).select(*_PREVIEW).orderBy("company", "year").limit(5)


# ------------------------------------------------------ B: data quality --

_NUM_RAW = [c for c in ALL_RAW if c not in ("company", "sector")]


# Fixed values of the twin: the panel's columns and types.
_B1_TYPES = "company string, year int, sector string, " + ", ".join(f"{c} double" for c in ALL_RAW[3:])


@query("b1_schema_summary", O.with_layers(
    "raw", "SELECT position, column_name, data_type, data_type <> 'string' AS is_numeric, (SELECT count(*) FROM raw) AS n_rows, "
           "23 AS n_cols, 21 AS n_numeric FROM (VALUES " + ", ".join(
               "(%d, '%s', '%s')" % (i, *c.split()) for i, c in enumerate(_B1_TYPES.split(", "))) + ") t(position, column_name, data_type)"))
def b1_schema_summary(spark, sf_dir):
    """B1: the panel's columns by position, name and type, with its counts."""
    return Q.schema_summary(raw(spark, sf_dir).select(*ALL_RAW))


_tot_nulls = " + ".join(f"count_if({c} IS NULL)" for c in ALL_RAW)


@query("b2_null_totals", O.with_layers(
    "raw", f"SELECT count(*) * {len(ALL_RAW)} AS total_cells, ({_tot_nulls}) AS total_nulls, "
           f"round(({_tot_nulls}) * 100.0 / (count(*) * {len(ALL_RAW)}), 6) AS null_pct FROM raw"))
def b2_null_totals(spark, sf_dir):
    return Q.null_totals(raw(spark, sf_dir))


def _null_long_sql(src: str, cols) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count_if({c} IS NULL) AS missing_count, "
        f"round(count_if({c} IS NULL) * 100.0 / count(*), 6) AS missing_pct FROM {src}" for c in cols)


@query("b3_nulls_by_column", O.with_layers(
    "raw", f"SELECT * FROM ({_null_long_sql('raw', ALL_RAW)}) t WHERE missing_count > 0"))
def b3_nulls_by_column(spark, sf_dir):
    return Q.nulls_by_column(raw(spark, sf_dir))


@query("b4_key_nulls", O.with_layers(
    "raw", "SELECT count_if(year IS NULL) AS year_nulls, count_if(company IS NULL) AS company_nulls, "
           "count_if(sector IS NULL) AS sector_nulls FROM raw"))
def b4_key_nulls(spark, sf_dir):
    return Q.key_nulls(raw(spark, sf_dir))


_row_nulls = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in ALL_RAW)


@query("b5_nulls_by_group", O.with_layers(
    "raw", "SELECT level, group_key, n_null FROM ("
           f"SELECT 'company' AS level, company AS group_key, sum({_row_nulls}) AS n_null FROM raw GROUP BY company "
           f"UNION ALL SELECT 'year', CAST(year AS VARCHAR), sum({_row_nulls}) FROM raw GROUP BY year "
           f"UNION ALL SELECT 'sector', sector, sum({_row_nulls}) FROM raw GROUP BY sector) t "
           "WHERE group_key IS NOT NULL"))
def b5_nulls_by_group(spark, sf_dir):
    return Q.nulls_by_group(raw(spark, sf_dir))


@query("b6_panel_balance", PB + (
    "SELECT count(DISTINCT company) AS n_companies, count(DISTINCT year) AS n_years, "
    "count(DISTINCT company) * count(DISTINCT year) AS expected_rows, count(*) AS n_rows, "
    "count(DISTINCT company) * count(DISTINCT year) - count(*) AS missing_pairs, "
    "count(DISTINCT company) * count(DISTINCT year) = count(*) AS balanced FROM pb"))
def b6_panel_balance(spark, sf_dir):
    return Q.panel_balance(panel_b(spark, sf_dir))


@query("b6b_missing_pairs", PB + (
    "SELECT c.company, y.year FROM (SELECT DISTINCT company FROM pb) c, (SELECT DISTINCT year FROM pb) y "
    "WHERE NOT EXISTS (SELECT 1 FROM pb WHERE pb.company = c.company AND pb.year = y.year)"))
def b6b_missing_pairs(spark, sf_dir):
    return Q.missing_pairs(panel_b(spark, sf_dir))


# Fixed values of the twin: the 52 names of the report, as text.
_B7_NAMES = (
    "net_sales cost_of_sales gross_profit operating_income interest_income interest_expense other_income pretax_income "
    "income_tax net_income eps_diluted diluted_shares cfo capex acquisitions cfi debt_issuance debt_repayment "
    "share_buybacks dividends_paid cff net_change_in_cash depreciation stock_compensation working_capital_change cash "
    "accounts_receivable inventories other_current_assets current_assets ppe_net goodwill other_long_term_assets "
    "total_assets accounts_payable accrued_liabilities other_current_liabilities current_liabilities long_term_debt "
    "other_long_term_liabilities total_liabilities equity operating_expenses marketable_securities "
    "other_investing_activities other_financing_activities stock_price sector_benchmark inflation fed_rate gdp sp500").split()
_present = [c for c in _B7_NAMES if c in ALL_RAW]
_b7_rows = " UNION ALL ".join(
    (f"SELECT {i} AS position, '{c}' AS column_name, count_if({c} IS NULL) AS missing_count, "
     f"round(count_if({c} IS NULL) * 100.0 / count(*), 6) AS missing_pct, true AS present FROM raw")
    if c in ALL_RAW else
    (f"SELECT {i} AS position, '{c}' AS column_name, CAST(NULL AS BIGINT) AS missing_count, CAST(NULL AS DOUBLE) AS missing_pct, false AS present")
    for i, c in enumerate(_B7_NAMES))
_b7_total = ("SELECT 52, 'TOTAL', (%s), round((%s) * 100.0 / (count(*) * %d), 6), true FROM raw" % (
    " + ".join(f"count_if({c} IS NULL)" for c in _present),
    " + ".join(f"count_if({c} IS NULL)" for c in _present), len(_present)))


@query("b7_null_report", O.with_layers("raw", f"{_b7_rows} UNION ALL {_b7_total}"))
def b7_null_report(spark, sf_dir):
    """Nulls of the 52 named measures, absent ones without counts, total."""
    return Q.null_report(raw(spark, sf_dir), list(MEASURES))


_B8 = ["marketable_securities", "cash", "stock_price", "net_income"]
_b8_sql = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(covar_samp(CAST({a} IS NULL AS DOUBLE), CAST({b} IS NULL AS DOUBLE)) "
    f"/ NULLIF(stddev_samp(CAST({a} IS NULL AS DOUBLE)) * stddev_samp(CAST({b} IS NULL AS DOUBLE)), 0), 9) AS corr FROM raw"
    for a in _B8 for b in _B8)


@query("b8_null_corr", O.with_layers("raw", _b8_sql))
def b8_null_corr(spark, sf_dir):
    return Q.null_indicator_corr(raw(spark, sf_dir), _B8)


_DESCRIBE = FE.RATIO_COLUMNS[:14]
_b9_sql = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, "
    f"round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, "
    f"round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max FROM l1" for c in _DESCRIBE)


@query("b9_describe", O.with_layers("l1", _b9_sql))
def b9_describe(spark, sf_dir):
    return Q.describe(l1(spark, sf_dir), _DESCRIBE)


_b10_sql = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, min({c}) AS min, max({c}) AS max, avg({c}) AS mean FROM l1"
    for c in FE.RATIO_COLUMNS)


@query("b10_ranges", O.with_layers("l1", _b10_sql))
def b10_ranges(spark, sf_dir):
    return Q.ranges(l1(spark, sf_dir), FE.RATIO_COLUMNS)


# Columns each layer needs, in our column names.
LAYER_REQUIREMENTS = {
    "1_feature_intelligence": ["net_sales", "gross_profit", "operating_income", "total_assets",
                               "total_liabilities", "stock_price"],
    "2_macro_transmission": ["interest_expense", "long_term_debt", "inflation", "fed_rate", "gdp"],
    "3_regime_detection": ["sector_benchmark", "sp500", "gdp", "inflation"],
    "4_core_prediction": ["net_income", "eps_diluted", "operating_income"],
    "5_scenario_simulation": ["cfo", "capex"],
    "6_sensitivity": ["stock_price", "net_income", "total_assets"],
    "7_risk_dashboard": ["total_liabilities", "long_term_debt", "net_income"],
}
_b11_vals = ", ".join(f"('{layer}', '{c}')" for layer, cs in LAYER_REQUIREMENTS.items() for c in cs)
@query("b11_feature_availability",
       "SELECT layer, count_if(there) AS available, count(*) AS required, "
       "coalesce(list_sort(list(column_name) FILTER (WHERE NOT there)), []) AS missing FROM (SELECT *, column_name IN ("
       + ", ".join(f"'{c}'" for c in ALL_RAW) + f") AS there FROM (VALUES {_b11_vals}) r(layer, column_name)) t GROUP BY layer")
def b11_feature_availability(spark, sf_dir):
    return Q.feature_availability(clean(spark, sf_dir), LAYER_REQUIREMENTS)


_clean_nulls = " + ".join(f"count_if({c} IS NULL)" for c in ALL_RAW)


@query("b12_clean_gate", O.with_layers(
    "clean", f"SELECT ({_clean_nulls}) AS remaining_nulls, ({_clean_nulls}) = 0 AS is_clean FROM clean"))
def b12_clean_gate(spark, sf_dir):
    return Q.clean_gate(clean(spark, sf_dir))


@query("b13_nonzero_counts", O.with_layers("l2", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count_if({c} <> 0) AS non_zero FROM l2" for c in FE.THREE_WAY)))
def b13_nonzero_counts(spark, sf_dir):
    return Q.nonzero_counts(l2(spark, sf_dir), FE.THREE_WAY)


@query("b14_feature_families", O.with_layers("l2", " UNION ALL ".join(
    f"SELECT '{fam}' AS family, {len(cs)} AS n_features, (" + " + ".join(f"count_if({c} <> 0)" for c in cs)
    + ") AS non_zero_values FROM l2"
    for fam, cs in sorted(Q.group_families(O.RAW_COLS + FE.layer1_new_columns() + FE.layer2_new_columns(),
                                           FE.feature_family).items()))))
def b14_feature_families(spark, sf_dir):
    return Q.feature_families(l2(spark, sf_dir), FE.feature_family)


# ------------------------------------------------ C: cleaning/imputation --

_INTERP = ["marketable_securities", "stock_price", "sector_benchmark"]


@query("c2_interpolate", O.with_layers("clean", "SELECT company, year, " + ", ".join(_INTERP) + " FROM c_interp"))
def c2_interpolate(spark, sf_dir):
    """Position-based linear interpolation per company, both directions."""
    return CL.interpolate(raw(spark, sf_dir), _INTERP).select("company", "year", *_INTERP)


@query("c3_sector_year_median", O.with_layers("clean", "SELECT company, year, marketable_securities FROM c_sy"))
def c3_sector_year_median(spark, sf_dir):
    """Fill with the exact (sector, year) median (radix select)."""
    df = CL.interpolate(raw(spark, sf_dir), ["marketable_securities"])
    return CL.fill_group_median(df, ["marketable_securities"], ["sector", "year"]).select(
        "company", "year", "marketable_securities")


@query("c4_related_fill", O.with_layers("clean", "SELECT company, year, marketable_securities FROM c_rel"))
def c4_related_fill(spark, sf_dir):
    """C4: last-resort fill from a related metric (cash x 0.15)."""
    df = CL.interpolate(raw(spark, sf_dir), ["marketable_securities"])
    df = CL.fill_group_median(df, ["marketable_securities"], ["sector", "year"])
    return CL.fill_from_related(df, "marketable_securities", "cash", 0.15).select(
        "company", "year", "marketable_securities")


@query("c5_clean_panel", O.with_layers("clean", f"SELECT {cols_sql(ALL_RAW)} FROM clean"))
def c5_clean_panel(spark, sf_dir):
    """The whole cleaning layer (company then global medians last)."""
    return clean(spark, sf_dir).select(*ALL_RAW)


_RC = FE.RATIO_COLUMNS


@query("c6_ratio_impute", O.with_layers("l1", "SELECT company, year, " + ", ".join(_RC) + " FROM f_rg"))
def c6_ratio_impute(spark, sf_dir):
    """Company -> sector-year -> global median, in sequence."""
    return FE.impute_ratios(FE.add_ratios(clean(spark, sf_dir))).select("company", "year", *_RC)


_FAM = FE.members(FE.layer1_new_columns(), "interaction", "volatility")


@query("c9_interaction_impute", O.with_layers("l1", "SELECT company, year, " + ", ".join(_FAM) + " FROM l1"))
def c9_interaction_impute(spark, sf_dir):
    """Company median -> global median -> 0 on the interaction family."""
    return l1(spark, sf_dir).select("company", "year", *_FAM)


# ------------------------------------------- D/F: expressions and windows --

_D1 = _RC + ["stock_return_company", "stock_return_sector", "gdp_growth"]


@query("d1_d6_ratios", O.with_layers("l1", "SELECT company, year, " + ", ".join(_D1) + " FROM f_ratio"))
def d1_d6_ratios(spark, sf_dir):
    """Ratios with NULL for undefined divisions, clipped size."""
    return FE.add_ratios(clean(spark, sf_dir)).select("company", "year", *_D1)


_D7 = FE.INTERACTION_COLUMNS + ["cash_rate_interaction"]


@query("d7_interactions", O.with_layers("l1", "SELECT company, year, " + ", ".join(_D7) + " FROM f_int2"))
def d7_interactions(spark, sf_dir):
    """Macro x firm interactions before imputation."""
    df = FE.add_history(FE.impute_ratios(FE.add_ratios(clean(spark, sf_dir))))
    df = df.withColumns(FE.layer_forms(FE.INTERACTION_COLUMNS, FE.panel_macro()))
    df = df.withColumns(FE.layer_forms(["cash_rate_interaction"], FE.panel_macro()))
    return df.select("company", "year", *_D7)


_D9 = ["recession"] + FE.THREE_WAY


@query("d8_d9_three_way", O.with_layers("l2", "SELECT company, year, " + ", ".join(_D9) + " FROM l2"))
def d8_d9_three_way(spark, sf_dir):
    """D8 recession flag, D9 three-way terms."""
    return l2(spark, sf_dir).select("company", "year", *_D9)


_D10 = (FE.INFLATION_BANDS + FE.RATE_BANDS + FE.GROWTH_BANDS + ["fed_rate_change"]
        + FE.POLICY_BANDS + ["stagflation", "regime_code"])


@query("d10_d15_rule_regimes", O.with_layers("l2", "SELECT company, year, " + ", ".join(_D10) + " FROM l2"))
def d10_d15_rule_regimes(spark, sf_dir):
    """Band indicators, policy bands, stagflation, regime code."""
    return l2(spark, sf_dir).select("company", "year", *_D10)


@query("d15b_regime_key", O.with_layers(
    "l2", "SELECT company, year, regime_code, concat(CASE WHEN inflation < 0 THEN 1 WHEN inflation <= 2 THEN 2 WHEN inflation <= 5 THEN 3 "
          "WHEN inflation > 5 THEN 4 ELSE 0 END, '-', CASE WHEN gdp_growth < -2 THEN 1 WHEN gdp_growth < 0 THEN 2 WHEN gdp_growth < 2 THEN 3 "
          "WHEN gdp_growth >= 2 THEN 4 ELSE 0 END) AS regime_key FROM l2"))
def d15b_regime_key(spark, sf_dir):
    """The regime code, which two band pairs share, beside a key that is
    one to one with the inflation and growth bands."""
    p = l2(spark, sf_dir)
    key = FE.regime_key()
    return p.select("company", "year", "regime_code", F.concat_ws("-", key["inflation_band"], key["growth_band"]).alias("regime_key"))


_D16 = FE.STRESS_PARTS + ["stress_intensity"]


@query("d16_stress", O.with_layers("l2", "SELECT company, year, " + ", ".join(_D16) + " FROM l2"))
def d16_stress(spark, sf_dir):
    """Clipped stress parts and stress intensity."""
    return l2(spark, sf_dir).select("company", "year", *_D16)


_HIST = ([f"{v}_lag{k}" for v in FE.LAG_VARIABLES for k in (1, 2)]
         + [f"{v}_rolling3" for v in FE.ROLLING_VARIABLES] + ["roa_volatility"]
         + [f"{v}_trend" for v in FE.ROLLING_VARIABLES])


@query("f1_f5_history", O.with_layers("l1", "SELECT company, year, " + ", ".join(_HIST) + " FROM f_int"))
def f1_f5_history(spark, sf_dir):
    """F1 lags (zero filled), F4 rolling(3) means, F5 rolling(5, min 3) std, D18 trends."""
    return FE.add_history(FE.impute_ratios(FE.add_ratios(clean(spark, sf_dir)))).select(
        "company", "year", *_HIST)


# ------------------------------------------------------------- flagship --

@query("flagship_sector_summary", O.with_layers(
    "l1", "SELECT sector, count(*) AS n_rows, avg(roa) AS avg_roa, stddev_samp(roa) AS std_roa, "
          "min(roa) AS min_roa, max(roa) AS max_roa, avg(debt_ratio) AS avg_debt_ratio, "
          "stddev_samp(debt_ratio) AS std_debt_ratio, avg(roa_rolling3) AS avg_roa_rolling3, "
          "avg(roa_lag1) AS avg_roa_lag1 FROM l1 GROUP BY sector"))
def flagship_sector_summary(spark, sf_dir):
    """Raw panel -> cleaning -> ratios, lags, rolling -> per-sector summary."""
    df = l1(spark, sf_dir)
    return df.groupBy("sector").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("roa").alias("avg_roa"),
        F.stddev_samp("roa").alias("std_roa"), F.min("roa").alias("min_roa"),
        F.max("roa").alias("max_roa"), F.avg("debt_ratio").alias("avg_debt_ratio"),
        F.stddev_samp("debt_ratio").alias("std_debt_ratio"),
        F.avg("roa_rolling3").alias("avg_roa_rolling3"), F.avg("roa_lag1").alias("avg_roa_lag1"))


# --------------------------------------------------- regimes (rule based) --
from ..operators import regimes as R  # noqa: E402

_MV = R.MACRO_VARS
_RULE_SQL = ("CASE WHEN {s} > 60 THEN 'HIGH_STRESS' WHEN {i} > 5 AND {r} > 3 THEN 'HIGH_INFLATION_TIGHTENING' "
             "WHEN {i} > 5 THEN 'HIGH_INFLATION' WHEN {g} < 0 THEN 'RECESSION' WHEN {r} > 4 THEN 'HIGH_RATES' "
             "WHEN {r} <= 1 THEN 'ZERO_RATES' WHEN {g} > 3 THEN 'STRONG_GROWTH' ELSE 'NORMAL' END")
_rule = _RULE_SQL.format(i="inflation", r="fed_rate", g="gdp_growth", s="stress_intensity")
_RULE_CTE = [("rr", f"SELECT year, {cols_sql(_MV)} FROM (SELECT year, {cols_sql(_MV)}, count(*) AS n FROM l2 WHERE "
                    + " AND ".join(f"{c} IS NOT NULL" for c in ["year"] + _MV)
                    + f" GROUP BY ALL) v QUALIFY row_number() OVER (PARTITION BY year ORDER BY n DESC, {cols_sql(_MV)}) = 1"),
             ("rn", f"SELECT year, {cols_sql(_MV)}, {_rule} AS regime_name FROM rr")]


@query("j17_macro_series", O.with_layers("l2", f"SELECT year, {cols_sql(_MV)}, "
       + ", ".join(f"avg({c}) OVER () AS {c}_mean" for c in _MV) + " FROM rr", _RULE_CTE[:1]))
def j17_macro_series(spark, sf_dir):
    """Macro table (distinct, NULL-free) with each series' mean."""
    return R.macro_series(l2(spark, sf_dir))


@query("d25_rule_regimes", O.with_layers("l2", "SELECT * FROM rn", _RULE_CTE))
def d25_rule_regimes(spark, sf_dir):
    """Regime names by the first matching rule, per period."""
    return R.rule_regimes(l2(spark, sf_dir))


@query("g1_regime_lookup", O.with_layers(
    "l2", "SELECT l2.company, l2.year, rn.regime_name FROM l2 LEFT JOIN rn ON l2.year = rn.year", _RULE_CTE))
def g1_regime_lookup(spark, sf_dir):
    """G1: period -> regime lookup joined to every panel row (broadcast)."""
    p = l2(spark, sf_dir)
    return R.label_panel(p.select("company", "year"), R.rule_regimes(p).select("year", "regime_name"))


@query("f9_regime_transitions", O.with_layers(
    "l2", "SELECT year, regime_name, previous FROM (SELECT year, regime_name, "
          "lag(regime_name) OVER (ORDER BY year) AS previous FROM rn) t "
          "WHERE previous IS NOT NULL AND previous <> regime_name", _RULE_CTE))
def f9_regime_transitions(spark, sf_dir):
    """periods whose regime differs from the previous period's."""
    return R.transitions(R.rule_regimes(l2(spark, sf_dir)), "regime_name")


_G1 = "SELECT l2.*, rn.regime_name FROM l2 LEFT JOIN rn ON l2.year = rn.year"


@query("e12_regime_share", O.with_layers(
    "l2", "SELECT regime_name, count(*) AS n_rows, count(*) * 100.0 / sum(count(*)) OVER () AS share_pct "
          "FROM lab GROUP BY regime_name", _RULE_CTE + [("lab", _G1)]))
def e12_regime_share(spark, sf_dir):
    """Share of panel rows per regime."""
    p = l2(spark, sf_dir)
    return R.regime_share(R.label_panel(p, R.rule_regimes(p).select("year", "regime_name")), "regime_name")


@query("j18_regime_economics", O.with_layers(
    "l2", "SELECT regime_name, avg(roa) AS roa_mean, stddev_samp(roa) AS roa_std, "
          "avg(perfect_storm_risk) AS perfect_storm_risk_mean, stddev_samp(perfect_storm_risk) AS perfect_storm_risk_std, "
          "count(*) AS n_rows FROM lab GROUP BY regime_name", _RULE_CTE + [("lab", _G1)]))
def j18_regime_economics(spark, sf_dir):
    """Roa and perfect-storm mean/std/count by regime."""
    p = l2(spark, sf_dir)
    return R.economic_check(R.label_panel(p, R.rule_regimes(p).select("year", "regime_name")), "regime_name")


@query("i1_standardize", O.with_layers(
    "l2", f"SELECT year, " + ", ".join(
        f"({c} - avg({c}) OVER ()) / NULLIF(stddev_pop({c}) OVER (), 0) AS z_{c}" for c in _MV)
    + " FROM rr", _RULE_CTE[:1]))
def i1_standardize(spark, sf_dir):
    """Standardised macro table (population std)."""
    t = R.period_table(l2(spark, sf_dir), _MV)
    return R.standardize(t, _MV).select("year", *[f"z_{c}" for c in _MV])


# ----------------------------------------------- scenarios (linear scorer) --
from ..operators import scenarios as S  # noqa: E402
from ..operators import risk as RK  # noqa: E402

TARGETS = ["roa", "profit_margin"]
_SC_NEED = sorted({f for t in TARGETS for f, _ in S.LINEAR_SCORER[t][1]} | {
    "sector", "inflation", "fed_rate", "gdp_growth", "gdp", "debt_ratio", "debt_to_equity",
    "current_ratio", "gross_margin", "asset_turnover", "profit_margin", "firm_size", "quick_ratio",
    "roa_volatility"})


def _latest(spark, sf_dir):
    return S.latest_per_company(l2(spark, sf_dir), _SC_NEED)


def _scored_by(spark, sf_dir, kind):
    """(panel, latest row per firm, scorer): ``linear`` is the scorer that SQL
    can state, ``trees`` the trained models on the layer-3 panel."""
    if kind == "linear":
        return l2(spark, sf_dir), _latest(spark, sf_dir), S.linear_scorer()
    p, feats = l3(spark, sf_dir), _features(spark, sf_dir)
    need = [c for c in p.columns if c in {*_SC_NEED, *feats} - {"company"}]
    return p, S.latest_per_company(p, need), BO.arrow_scorer(_boosted(spark, sf_dir))


def _pred(spark, sf_dir, kind="linear"):
    key = (spark.sparkContext.applicationId, sf_dir, "pred", kind)
    if key not in _CACHE:
        panel, latest, scorer = _scored_by(spark, sf_dir, kind)
        _CACHE[key] = cut_lineage(S.score_scenarios(latest, S.baseline_macros(panel), TARGETS, scorer))
    return _CACHE[key]


def _wide(spark, sf_dir, kind="linear"):
    return S.base_vs_scenarios(_pred(spark, sf_dir, kind))


def _risk(spark, sf_dir, kind="linear"):
    key = (spark.sparkContext.applicationId, sf_dir, "risk", kind)
    if key not in _CACHE:
        _CACHE[key] = cut_lineage(RK.risk_scores(_wide(spark, sf_dir, kind), RK.roa_history(l2(spark, sf_dir))))
    return _CACHE[key]


_upd = O.update_terms_sql("s_inflation", "s_interest", "s_gdp")
_sc_vals = ", ".join(f"('{k}', {O.d(i)}, {O.d(r)}, {O.d(g)})" for k, _n, i, r, g in S.SCENARIOS)
_latest_cols = [c for c in _SC_NEED]
_firm_cols = [c for c in _latest_cols if c not in _upd]
_SC_CTES = [
    ("lt", O.latest_sql(_latest_cols)),
    ("bl", "SELECT inflation AS b_i, fed_rate AS b_r, gdp_growth AS b_g FROM l2 "
           "WHERE year = (SELECT max(year) FROM l2) ORDER BY company LIMIT 1"),
    ("sc", f"SELECT s.scenario, bl.b_i + s.di AS s_inflation, bl.b_r + s.dr AS s_interest, "
           f"bl.b_g + s.dg AS s_gdp FROM (VALUES {_sc_vals}) s(scenario, di, dr, dg), bl"),
    ("fx", "SELECT sc.scenario, lt.company, " + ", ".join(f"lt.{c}" for c in _firm_cols) + ", "
           + ", ".join(f"{v} AS {k}" for k, v in _upd.items()) + " FROM lt, sc"),
    ("pred", " UNION ALL ".join(
        f"SELECT '{t}' AS target, scenario, company, coalesce(sector, 'Unknown') AS sector, "
        f"{O.score_sql(t, S.LINEAR_SCORER)} AS predicted, debt_ratio, current_ratio FROM fx" for t in TARGETS)),
    ("wide", "SELECT target, company, any_value(sector) AS sector, any_value(debt_ratio) AS debt_ratio, "
             "any_value(current_ratio) AS current_ratio, "
             + ", ".join(f"max(CASE WHEN scenario = '{k}' THEN predicted END) AS {k.lower()}"
                         for k, *_ in S.SCENARIOS) + " FROM pred GROUP BY target, company"),
]


@query("e4_latest_per_company", O.with_layers("l2", "SELECT * FROM lt", _SC_CTES[:1]))
def e4_latest_per_company(spark, sf_dir):
    """Per company, each column's latest non-null value."""
    return _latest(spark, sf_dir)


@query("j2_scenario_table", O.with_layers("l2", "SELECT * FROM sc", _SC_CTES[:3]))
def j2_scenario_table(spark, sf_dir):
    """Baseline macros of the latest period + the 7 shifts."""
    base = S.baseline_macros(l2(spark, sf_dir))
    return S.scenario_table(spark, base).select("scenario", "s_inflation", "s_interest", "s_gdp")


@query("j4_scenario_predictions", O.with_layers("l2", "SELECT * FROM pred", _SC_CTES[:5]))
def j4_scenario_predictions(spark, sf_dir):
    """All firms x 7 scenarios, macro terms recomputed, scored."""
    return _pred(spark, sf_dir)


_IMP = " UNION ALL ".join(
    f"SELECT target, '{k}' AS scenario, '{n}' AS scenario_name, "
    f"avg(({k.lower()} - base) / greatest(abs(base), {O.d(0.001)}) * 100) AS impact_pct FROM wide GROUP BY target"
    for k, n, *_ in S.SCENARIOS if k in S.IMPACT_SCENARIOS)


@query("j5_stress_impact", O.with_layers(
    "l2", f"SELECT *, CASE WHEN impact_pct > 0 THEN 'UP' ELSE 'DOWN' END AS direction FROM ({_IMP}) t", _SC_CTES))
def j5_stress_impact(spark, sf_dir):
    """Mean % change vs BASE per scenario and target."""
    return S.stress_impacts(_wide(spark, sf_dir))


_RISK_SQL = (
    "SELECT w.company, w.sector, upper(w.target) AS target, "
    "round_even(0.4 * v + 0.3 * l + 0.2 * o + 0.1 * q, 2) AS risk_score, round_even(v, 2) AS stress_vulnerability, "
    "round_even(l, 2) AS leverage_risk, round_even(o, 2) AS volatility_risk, round_even(q, 2) AS liquidity_risk, "
    "round_even(base, 4) AS baseline, round_even(stagflation, 4) AS stagflation FROM (SELECT w.*, "
    f"greatest({O.d(0.0)}, least({O.d(100.0)}, CASE WHEN abs(base) > 0.001 THEN (base - stagflation) / abs(base) * 100 ELSE {O.d(50.0)} END)) AS v, "
    f"least({O.d(100.0)}, coalesce(debt_ratio, {O.d(0.5)}) * 100) AS l, "
    f"CASE WHEN h.roa_n > 1 THEN least({O.d(100.0)}, h.roa_std * 100 * 2) ELSE {O.d(20.0)} END AS o, "
    f"greatest({O.d(0.0)}, least({O.d(100.0)}, ({O.d(1.0)} / NULLIF(coalesce(current_ratio, {O.d(1.0)}) + {O.d(0.01)}, 0)) * 50)) AS q "
    "FROM wide w LEFT JOIN (SELECT company, stddev_pop(roa) AS roa_std, count(roa) AS roa_n FROM l2 GROUP BY company) h "
    "ON w.company = h.company) w")
_RISK_CTES = _SC_CTES + [("risk", _RISK_SQL)]


@query("j6_risk_scores", O.with_layers("l2", "SELECT * FROM risk", _RISK_CTES))
def j6_risk_scores(spark, sf_dir):
    """Risk score components per (target, company)."""
    return _risk(spark, sf_dir)


@query("j7_primary_extremes", O.with_layers(
    "l2", "SELECT *, CASE WHEN risk_score > 60 THEN 'HIGH' WHEN risk_score > 35 THEN 'MED' ELSE 'LOW' END "
          "AS screen_level FROM (SELECT * FROM (SELECT 'top' AS side, company, sector, risk_score FROM risk "
          "WHERE target = 'ROA' ORDER BY risk_score DESC, company LIMIT 10) a UNION ALL SELECT * FROM "
          "(SELECT 'bottom', company, sector, risk_score FROM risk WHERE target = 'ROA' "
          "ORDER BY risk_score ASC, company LIMIT 10) b) t",
    _RISK_CTES))
def j7_primary_extremes(spark, sf_dir):
    """Top and bottom 10 ROA risk scores."""
    return RK.primary_extremes(_risk(spark, sf_dir))


_WARN_SQL = (
    "SELECT company, sector, upper(target) AS target, "
    "concat_ws(' | ', CASE WHEN dp > 30 THEN printf('CRITICAL: %.0f%% drop under stagflation', dp) END, "
    "CASE WHEN dr > 0.7 THEN printf('HIGH LEVERAGE: %.1f%%', dr * 100) END, "
    "CASE WHEN cr < 1 THEN printf('LIQUIDITY CRISIS: Current ratio = %.2f', cr) END) AS warnings, "
    "round_even(dp, 1) AS stress_drop_pct, round_even(dr, 3) AS leverage, round_even(cr, 2) AS current_ratio "
    f"FROM (SELECT *, CASE WHEN abs(base) > 0.001 THEN (base - stagflation) / abs(base) * 100 ELSE {O.d(0.0)} END AS dp, "
    f"coalesce(debt_ratio, {O.d(0.0)}) AS dr, coalesce(current_ratio, {O.d(1.0)}) AS cr FROM wide) t "
    "WHERE dp > 30 OR dr > 0.7 OR cr < 1")
_WARN_CTES = _RISK_CTES + [("warn", _WARN_SQL)]


@query("j10_warnings", O.with_layers("l2", "SELECT * FROM warn", _WARN_CTES))
def j10_warnings(spark, sf_dir):
    """Warning signals (drop > 30%, leverage > .7, liquidity < 1),
    largest drop first."""
    return RK.by_drop(RK.warnings(_wide(spark, sf_dir)))


@query("j11_warning_types", O.with_layers(
    "l2", "SELECT warning_type, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS share_pct FROM ("
          "SELECT 'High Leverage' AS warning_type FROM warn WHERE contains(warnings, 'HIGH LEVERAGE') "
          "UNION ALL SELECT 'Liquidity Crisis' FROM warn WHERE contains(warnings, 'LIQUIDITY CRISIS') "
          "UNION ALL SELECT 'Critical Drop' FROM warn WHERE contains(warnings, 'CRITICAL')) t GROUP BY warning_type",
    _WARN_CTES))
def j11_warning_types(spark, sf_dir):
    """Warning-type counts and shares."""
    return RK.warning_types(RK.warnings(_wide(spark, sf_dir)))


@query("j11b_warnings_per_firm", O.with_layers(
    "l2", "SELECT company, count(*) AS n_warnings FROM warn GROUP BY company "
          "ORDER BY n_warnings DESC, company LIMIT 10", _WARN_CTES))
def j11b_warnings_per_firm(spark, sf_dir):
    """Firms with the most warning rows (top 10)."""
    return RK.warnings_per_firm(RK.warnings(_wide(spark, sf_dir)))


_LEVEL = ("CASE WHEN risk_score >= 60 THEN 'CRITICAL' WHEN risk_score >= 40 THEN 'HIGH' "
          "WHEN risk_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END")


@query("j12_risk_ranking", O.with_layers(
    "l2", f"SELECT *, row_number() OVER (ORDER BY risk_score DESC, company, target) AS rank, "
          f"{_LEVEL} AS risk_level FROM risk", _RISK_CTES))
def j12_risk_ranking(spark, sf_dir):
    """Global ranking by score with levels (distributed rank)."""
    return RK.risk_ranking(_risk(spark, sf_dir))


@query("j13_sector_summary", O.with_layers(
    "l2", "SELECT *, CASE WHEN avg_risk >= 40 THEN '!' WHEN avg_risk >= 25 THEN '?' ELSE '.' END AS flag, CASE WHEN avg_risk >= 40 THEN "
          "'darkred' WHEN avg_risk >= 25 THEN 'red' WHEN avg_risk >= 15 THEN 'orange' ELSE 'green' END AS band FROM (SELECT sector, "
          "round_even(CAST(sum(CAST(risk_score AS DECIMAL(12, 2))) AS DOUBLE) / count(risk_score), 2) AS avg_risk, round_even(stddev_samp(risk_score), 2) AS std_risk, "
          "round_even(min(risk_score), 2) AS min_risk, round_even(max(risk_score), 2) AS max_risk, "
          "count(risk_score) AS firm_count, count(DISTINCT company) AS n_firms FROM risk GROUP BY sector) s", _RISK_CTES))
def j13_sector_summary(spark, sf_dir):
    """Sector risk summary, rounded and sorted, with flag and chart band."""
    return RK.sector_summary(_risk(spark, sf_dir))


@query("j13b_sector_firms", O.with_layers("l2", "SELECT DISTINCT sector, company FROM risk", _RISK_CTES))
def j13b_sector_firms(spark, sf_dir):
    """Firms per sector as a long table."""
    return RK.sector_firms(_risk(spark, sf_dir))


@query("j14_sector_primary", O.with_layers(
    "l2", "SELECT sector, avg(risk_score) AS avg_risk, CASE WHEN avg(risk_score) > 60 THEN 'darkred' "
          "WHEN avg(risk_score) > 40 THEN 'red' WHEN avg(risk_score) > 25 THEN 'orange' ELSE 'green' END AS band "
          "FROM risk WHERE target = 'ROA' GROUP BY sector", _RISK_CTES))
def j14_sector_primary(spark, sf_dir):
    """Sector mean of the ROA risk score with chart band."""
    return RK.sector_primary_mean(_risk(spark, sf_dir))


@query("e14_scenario_pivot", O.with_layers(
    "l2", "SELECT scenario, " + ", ".join(
        f"coalesce(avg(CASE WHEN target = '{t}' THEN predicted END), {O.d(0.0)}) AS {t}" for t in TARGETS)
    + " FROM pred GROUP BY scenario", _SC_CTES))
def e14_scenario_pivot(spark, sf_dir):
    """Scenario x target mean predictions (0 if missing)."""
    return RK.scenario_pivot(_pred(spark, sf_dir), TARGETS)


@query("h8_sector_performance", O.with_layers(
    "l2", "SELECT upper(target) AS target, scenario, sector, avg(predicted) AS mean_predicted FROM pred "
          "WHERE scenario IN ('BASE', 'STAGFLATION', 'RECESSION', 'INFLATION_SHOCK') "
          "GROUP BY upper(target), scenario, sector", _SC_CTES))
def h8_sector_performance(spark, sf_dir):
    """H8/H5: mean prediction by sector for four scenarios and both targets."""
    return RK.sector_performance(_pred(spark, sf_dir))


# ------------------------------------------------------------ bootstrap --
N_SIMS = 500


def _draws(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, "draws")
    if key not in _CACHE:
        _CACHE[key] = cut_lineage(S.draw_table(l2(spark, sf_dir), N_SIMS))
    return _CACHE[key]


def _boot(spark, sf_dir, kind="linear"):
    key = (spark.sparkContext.applicationId, sf_dir, "boot", kind)
    if key not in _CACHE:
        _, latest, scorer = _scored_by(spark, sf_dir, kind)
        _CACHE[key] = cut_lineage(S.bootstrap_means(latest, _draws(spark, sf_dir), TARGETS, scorer))
    return _CACHE[key]


def _hash_sql(variable: str, stream: str) -> str:
    """The 60-bit hash of one draw, spelled out."""
    return (f"CAST(concat('0x', substr(md5(concat('42:', sim_id, ':{variable}:{stream}')), 1, 15)) AS BIGINT)")


_bvars = list(S.NOISE_SD)
_draw_cols = []
for _v in _bvars:
    _draw_cols += [
        f"{_hash_sql(_v, 'pick')} AS pick_{_v}",
        f"sqrt(-2.0 * ln(CAST({_hash_sql(_v, 'radius')} + 1 AS DOUBLE) / CAST(1152921504606846976 AS DOUBLE))) * "
        f"cos({O.d(2 * 3.141592653589793)} * (CAST({_hash_sql(_v, 'angle')} AS DOUBLE) / "
        f"CAST(1152921504606846976 AS DOUBLE))) AS z_{_v}"]
_draw_sel = ", ".join(
    f"(SELECT p.{_v} FROM perc p WHERE pick_{_v} % p.total >= p.cum - p.n_rows AND pick_{_v} % p.total < p.cum) "
    f"+ z_{_v} * {O.d(S.NOISE_SD[_v])} AS {_v}" for _v in _bvars)
_upd_d = O.update_terms_sql("d_i", "d_r", "d_g")
_firm_cols_d = [c for c in _latest_cols if c not in _upd_d]
_BOOT_CTES = _SC_CTES[:1] + [
    ("per", "SELECT year, CAST(sum(n) AS BIGINT) AS n_rows, " + ", ".join(f"arg_min({v}, (-n, {', '.join(_bvars)})) AS {v}" for v in _bvars)
            + f" FROM (SELECT year, {', '.join(_bvars)}, count(*) AS n FROM l2 GROUP BY ALL) v GROUP BY year"),
    ("perc", "SELECT *, sum(n_rows) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, "
             "sum(n_rows) OVER () AS total FROM per"),
    ("sims", f"SELECT sim_id, {', '.join(_draw_cols)} FROM (SELECT range AS sim_id FROM range({N_SIMS})) r"),
    ("draws", f"SELECT sim_id, {_draw_sel} FROM sims"),
    ("fxd", "SELECT dr.sim_id, " + ", ".join(f"lt.{c}" for c in _firm_cols_d) + ", "
            + ", ".join(f"{v} AS {k}" for k, v in _upd_d.items())
            + " FROM lt, (SELECT sim_id, inflation AS d_i, fed_rate AS d_r, gdp_growth AS d_g FROM draws) dr"),
    ("boot", " UNION ALL ".join(
        f"SELECT '{t}' AS target, sim_id, avg({O.score_sql(t, S.LINEAR_SCORER)}) AS mean_prediction "
        f"FROM fxd GROUP BY sim_id" for t in TARGETS)),
]


@query("j8_draw_table", O.with_layers("l2", "SELECT * FROM draws", _BOOT_CTES))
def j8_draw_table(spark, sf_dir):
    """Reproducible macro draws (period picked by panel-row weight + noise)."""
    return _draws(spark, sf_dir)


@query("j8_bootstrap_means", O.with_layers("l2", "SELECT * FROM boot", _BOOT_CTES))
def j8_bootstrap_means(spark, sf_dir):
    """All firms rescored under every draw; mean prediction per draw."""
    return _boot(spark, sf_dir)


@query("j8_bootstrap_summary", O.with_layers(
    "l2", "SELECT target, count(*) AS n_sims, avg(mean_prediction) AS mean, stddev_pop(mean_prediction) AS std, "
          "quantile_cont(mean_prediction, 0.05) AS ci_90_lower, quantile_cont(mean_prediction, 0.95) AS ci_90_upper, "
          "quantile_cont(mean_prediction, 0.025) AS ci_95_lower, quantile_cont(mean_prediction, 0.975) AS ci_95_upper, "
          "quantile_cont(mean_prediction, 0.975) - quantile_cont(mean_prediction, 0.025) AS ci_95_width "
          "FROM boot GROUP BY target", _BOOT_CTES))
def j8_bootstrap_summary(spark, sf_dir):
    """Mean, population std, 90%/95% bounds and interval width."""
    return S.bootstrap_summary(_boot(spark, sf_dir))


@query("j9_histogram", O.with_layers(
    "l2", "SELECT e.target, e.bin, coalesce(c.n, 0) AS n, e.lo, e.hi FROM (SELECT target, lo, hi, "
          "CAST(unnest(range(1, 51)) AS INTEGER) AS bin FROM (SELECT target, min(mean_prediction) AS lo, "
          "max(mean_prediction) AS hi FROM boot GROUP BY target) r) e LEFT JOIN ("
          "SELECT target, bin, count(*) AS n FROM (SELECT target, "
          "CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((mean_prediction - lo) / (hi - lo) * 50) + 1, 50) END AS INTEGER) AS bin "
          "FROM (SELECT *, min(mean_prediction) OVER (PARTITION BY target) AS lo, "
          "max(mean_prediction) OVER (PARTITION BY target) AS hi FROM boot) a) b GROUP BY target, bin) c USING (target, bin)", _BOOT_CTES))
def j9_histogram(spark, sf_dir):
    """50-bin histogram of the draw means, last edge inclusive."""
    return S.histogram(_boot(spark, sf_dir), 50)


# --------------------------------------- model metrics (linear scorer) --
from ..operators import boosting as BO  # noqa: E402
from ..operators import models as MD  # noqa: E402

_SPLIT_SQL = "CASE WHEN year <= 1999 THEN 'train' WHEN year >= 2001 THEN 'test' ELSE 'val' END"


def _scored_linear(spark, sf_dir):
    """I16 with the linear scorer: every panel row scored for both targets."""
    p = l2(spark, sf_dir).withColumn("split", MD.split_col())
    parts = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("actual"),
                               S.linear_score(t).alias("predicted")) for t in TARGETS])
    x = p.select("company", "year", "split", F.explode(parts).alias("s")).select(
        "company", "year", "split", "s.*")
    err = F.col("actual") - F.col("predicted")
    return x.withColumns({"error": err,
                          "error_pct": err / F.greatest(F.abs(F.col("actual")), F.lit(0.01)) * 100})


_SCORED_CTES = [("scored", "SELECT *, actual - predicted AS error, (actual - predicted) / "
                 f"greatest(abs(actual), {O.d(0.01)}) * 100 AS error_pct FROM (" + " UNION ALL ".join(
                     f"SELECT company, year, {_SPLIT_SQL} AS split, '{t}' AS target, {t} AS actual, "
                     f"{O.score_sql(t, S.LINEAR_SCORER)} AS predicted FROM l2" for t in TARGETS) + ") t")]


@query("i16_scored_panel", O.with_layers("l2", "SELECT * FROM scored", _SCORED_CTES))
def i16_scored_panel(spark, sf_dir):
    """All rows scored, error and error % per target."""
    return _scored_linear(spark, sf_dir)


_MET_SQL = ("SELECT target, split, count(*) AS n, 1 - sum(error * error) / NULLIF(var_pop(actual) * count(*), 0) AS r2, "
            "sqrt(sum(error * error) / count(*)) AS rmse, avg(abs(error)) AS mae FROM scored GROUP BY target, split")


def _metrics_linear(spark, sf_dir, groups=("split",)):
    s = _scored_linear(spark, sf_dir).withColumn("pred_col", F.col("predicted"))
    y, p = F.col("actual"), F.col("predicted")
    a = s.groupBy("target", *groups).agg(
        F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("sse"),
        F.var_pop(y).alias("vy"), F.avg(F.abs(y - p)).alias("mae"))
    return a.select("target", *groups, "n", (1 - F.try_divide(F.col("sse"), F.col("vy") * F.col("n"))).alias("r2"),
                    F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae")


@query("i12_split_metrics", O.with_layers("l2", _MET_SQL, _SCORED_CTES))
def i12_split_metrics(spark, sf_dir):
    """R2 / RMSE / MAE per target and split in one pass."""
    return _metrics_linear(spark, sf_dir)


@query("i12b_overfit_report", O.with_layers(
    "l2", "SELECT target, train_r2, test_r2, train_r2 - test_r2 AS gap, CASE WHEN train_r2 - test_r2 > 0.1 "
          "THEN 'Possible overfitting' ELSE 'Good generalization' END AS flag, CASE WHEN test_r2 > 0.9 THEN "
          "'EXCELLENT' WHEN test_r2 > 0.7 THEN 'GOOD' ELSE 'MODERATE' END AS status FROM (SELECT target, "
          "max(CASE WHEN split = 'train' THEN r2 END) AS train_r2, max(CASE WHEN split = 'test' THEN r2 END) "
          f"AS test_r2 FROM ({_MET_SQL}) m GROUP BY target) w", _SCORED_CTES))
def i12b_overfit_report(spark, sf_dir):
    """Train-test R2 gap, overfit flag and status per target."""
    return MD.overfit_report(_metrics_linear(spark, sf_dir))


@query("i15_regime_r2", O.with_layers(
    "l2", "SELECT target, regime_name, count(*) AS n, 1 - sum(error * error) / NULLIF(var_pop(actual) * count(*), 0) AS r2 "
          "FROM scored s JOIN rn ON s.year = rn.year WHERE split = 'test' GROUP BY target, regime_name "
          "HAVING count(*) >= 5", _RULE_CTE + _SCORED_CTES))
def i15_regime_r2(spark, sf_dir):
    """Test-split R2 per regime with at least 5 rows."""
    s = _scored_linear(spark, sf_dir).where(F.col("split") == "test")
    s = R.label_panel(s, R.rule_regimes(l2(spark, sf_dir)).select("year", "regime_name"))
    y, p = F.col("actual"), F.col("predicted")
    a = s.groupBy("target", "regime_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("sse"), F.var_pop(y).alias("vy"))
    return a.where(F.col("n") >= 5).select(
        "target", "regime_name", "n", (1 - F.try_divide(F.col("sse"), F.col("vy") * F.col("n"))).alias("r2"))


@query("i17_actual_vs_predicted", O.with_layers(
    "l2", "SELECT target, company, year, actual, predicted FROM scored WHERE split = 'test'", _SCORED_CTES))
def i17_actual_vs_predicted(spark, sf_dir):
    """Actual vs predicted pairs of the test split."""
    return _scored_linear(spark, sf_dir).where(F.col("split") == "test").select(
        "target", "company", "year", "actual", "predicted")


_E8 = [f"{t}_error" for t in TARGETS]


@query("e8_error_corr", O.with_layers(
    "l2", "SELECT a AS error_a, b AS error_b, round(c, 9) AS corr, coalesce(abs(c) > 0.5, false) AND a <> b AS strong FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, covar_samp(x_{a}, x_{b}) / NULLIF(stddev_samp(x_{a}) * stddev_samp(x_{b}), 0) AS c "
        f"FROM (SELECT " + ", ".join(f"max(CASE WHEN target = '{t}' THEN error END) AS x_{t}_error" for t in TARGETS)
        + " FROM scored GROUP BY company, year) w" for a in _E8 for b in _E8) + ") t", _SCORED_CTES))
def e8_error_corr(spark, sf_dir):
    """Correlation matrix of the targets' prediction errors."""
    s = _scored_linear(spark, sf_dir)
    w = s.groupBy("company", "year").agg(
        *[F.max(F.when(F.col("target") == t, F.col("error"))).alias(f"{t}_error") for t in TARGETS])
    return MD.error_corr(w, TARGETS).withColumn("corr", F.round("corr", 9))


# ------------------------------------- clustering (rows-only, Spark ML) --
from ..operators import attribution as AT  # noqa: E402
from ..sources.fixtures import MONTHS_C_SQL, months_c  # noqa: E402
from . import clusters as CU  # noqa: E402

_C_VARS = ["n_orders", "avg_price", "urgent_share", "finished_share"]
_C_Z = [f"z_{c}" for c in _C_VARS]


def _months_z(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, "months_z")
    if key not in _CACHE:
        _CACHE[key] = cut_lineage(R.standardize(months_c(spark, sf_dir), _C_VARS))
    return _CACHE[key]


_C_POINTS = [("mc", duckdb_sql(MONTHS_C_SQL)), ("pts", "SELECT period, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / NULLIF(stddev_pop({c}) OVER (), 0) AS z_{c}" for c in _C_VARS) + " FROM mc")]
_C_KM = _C_POINTS + CU.kmeans_ctes("pts", "period", _C_Z)


def _sweep(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, "sweep")
    if key not in _CACHE:
        _CACHE[key] = cut_lineage(R.kmeans_sweep(_months_z(spark, sf_dir), _C_Z, 6, "period"))
    return _CACHE[key]


def _k(spark, sf_dir) -> int:
    return int(R.choose_k(_sweep(spark, sf_dir)).first()["k"])


def _kmeans_c(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, "kmeans_c")
    if key not in _CACHE:
        _CACHE[key] = cut_lineage(R.fit_kmeans(_months_z(spark, sf_dir), _C_Z, _k(spark, sf_dir), "period"))
    return _CACHE[key]


@query("i2_k_sweep", CU.chained(_C_KM, "SELECT k, inertia FROM sweep"))
def i2_k_sweep(spark, sf_dir):
    """Inertia of the best of ten restarts for k = 1..6 on the month table."""
    return _sweep(spark, sf_dir)


@query("i2b_gmm_bic")
def i2b_gmm_bic(spark, sf_dir):
    """BIC of Gaussian mixtures for k = 1..6 on the month table."""
    return R.gmm_sweep(_months_z(spark, sf_dir), _C_Z, 6)


@query("i3_choose_k", CU.chained(_C_KM, "SELECT CAST(k AS INTEGER) AS k FROM chosen"))
def i3_choose_k(spark, sf_dir):
    """Elbow choice of k from the sweep."""
    return R.choose_k(_sweep(spark, sf_dir))


@query("i4_kmeans_labels", CU.chained(_C_KM, f"SELECT period, {cols_sql(_C_Z)}, regime AS regime_kmeans FROM labels JOIN pts USING (period)"))
def i4_kmeans_labels(spark, sf_dir):
    """I4: k-means labels (10 restarts, stable label order) per period."""
    return _kmeans_c(spark, sf_dir).select("period", *_C_Z, "regime_kmeans")


@query("i5_gmm_labels")
def i5_gmm_labels(spark, sf_dir):
    """Gaussian-mixture labels, class probabilities, confidence."""
    g = R.fit_gmm(_months_z(spark, sf_dir), _C_Z, _k(spark, sf_dir))
    return g.drop("features")


@query("i6_cluster_profile", CU.chained(
    _C_KM, "SELECT regime AS regime_kmeans, " + ", ".join(f"avg({c}) AS avg_{c}" for c in _C_VARS)
           + ", list_sort(list(period)) AS periods, count(*) AS n_periods FROM labels JOIN mc USING (period) GROUP BY regime"))
def i6_cluster_profile(spark, sf_dir):
    """Mean of each measure and the period list per k-means label."""
    return R.cluster_profile(_kmeans_c(spark, sf_dir), "regime_kmeans", _C_VARS, "period")


def _banded(rows: DataFrame, method: str) -> DataFrame:
    return rows.select(F.lit(method).alias("method"), "silhouette", R.silhouette_band(F.col("silhouette")).alias("quality"))


@query("i7_silhouette", CU.chained(
    _C_KM, "SELECT 'kmeans' AS method, silhouette, CASE WHEN silhouette > 0.5 THEN 'strong' WHEN silhouette > 0.3 THEN 'reasonable' "
           f"ELSE 'weak' END AS quality FROM ({CU.silhouette_sql('pts', 'period', _C_Z)}) s"))
def i7_silhouette(spark, sf_dir):
    """Exact Euclidean silhouette of the k-means labels with its band."""
    return _banded(R.silhouette(_kmeans_c(spark, sf_dir), "regime_kmeans", _C_Z), "kmeans")


@query("i7b_gmm_silhouette")
def i7b_gmm_silhouette(spark, sf_dir):
    """Exact Euclidean silhouette of the mixture's labels."""
    g = cut_lineage(i5_gmm_labels(spark, sf_dir))
    return _banded(R.silhouette(g, "regime_gmm", _C_Z), "gmm")


@query("i8_pca", CU.chained(
    _C_POINTS + CU.pca_ctes("pts", _C_Z),
    "SELECT period, round(" + " + ".join(f"{c} * a.v{i}" for i, c in enumerate(_C_Z)) + ", 6) AS pc1, round("
    + " + ".join(f"{c} * b.v{i}" for i, c in enumerate(_C_Z))
    + ", 6) AS pc2, round(a.spread / total, 6) AS explained_1, round(b.spread / total, 6) AS explained_2 "
    "FROM pts, pc1v a, pc2v b, whole"))
def i8_pca(spark, sf_dir):
    """I8: two-component projection of the standardised table, to 6 digits."""
    out, ratio = R.pca2(_months_z(spark, sf_dir), _C_Z)
    values = {"pc1": F.col("pc1"), "pc2": F.col("pc2"), "explained_1": F.lit(ratio[0]), "explained_2": F.lit(ratio[1])}
    return out.select("period", *[F.round(v, 6).alias(n) for n, v in values.items()])


# -------------------------------------- panel regimes + models (rows-only) --

def _analysis(spark, sf_dir) -> PanelAnalysis:
    """Layers 3 and 4 of the fixture panel, on the layers that are there."""
    key = (spark.sparkContext.applicationId, sf_dir, "analysis")
    if key not in _CACHE:
        a = PanelAnalysis(raw(spark, sf_dir), TARGETS, split={"train_end": 1999, "test_start": 2001})
        a.macro = l2(spark, sf_dir)
        _CACHE[key] = a
    return _CACHE[key]


def l3(spark, sf_dir):
    """Layer 3: labelled panel."""
    return _analysis(spark, sf_dir).regimes


@query("d20_regime_products")
def d20_regime_products(spark, sf_dir):
    """Panel rows with k-means regime, GMM confidence, name,
    dummies and regime x feature products."""
    p = l3(spark, sf_dir)
    cols = ["company", "year", "regime", "regime_gmm", "regime_confidence", "low_confidence", "regime_name"]
    cols += [c for c in p.columns if c.startswith("regime_") and c.endswith("_dummy")]
    cols += [c for c in p.columns if "_x_regime_" in c]
    return p.select(*cols)


_L3_KM = _RULE_CTE[:1] + [("pts", "SELECT year, " + cols_sql(_MV) + ", " + ", ".join(
    f"({c} - avg({c}) OVER ()) / NULLIF(stddev_pop({c}) OVER (), 0) AS z_{c}" for c in _MV) + " FROM rr")] \
    + CU.kmeans_ctes("pts", "year", [f"z_{c}" for c in _MV]) + [
    ("named", "SELECT regime, " + _RULE_SQL.format(i="avg(inflation)", r="avg(fed_rate)", g="avg(gdp_growth)", s="avg(stress_intensity)")
              + " AS regime_name FROM labels JOIN pts USING (year) GROUP BY regime")]


@query("d20b_regime_products", CU.chained(
    O.layer_ctes("l2") + _L3_KM,
    "SELECT company, l2.year, regime, regime_name, " + ", ".join(
        f"CAST(coalesce(regime = {r}, false) AS INTEGER) AS regime_{r}_dummy" for r in (0, 1)) + ", "
    + ", ".join(f"{c} * CAST(coalesce(regime = {r}, false) AS INTEGER) AS {c}_x_regime_{r}" for c in ("roa", "debt_ratio", "rollover_risk") for r in (0, 1))
    + " FROM l2 LEFT JOIN labels ON l2.year = labels.year LEFT JOIN named USING (regime)"))
def d20b_regime_products(spark, sf_dir):
    """K-means regime, its name, and the dummies and some products of
    the first two regimes, which any choice of k has."""
    return l3(spark, sf_dir).select("company", "year", "regime", "regime_name", "regime_0_dummy", "regime_1_dummy", *[
        f"{c}_x_regime_{r}" for c in ("roa", "debt_ratio", "rollover_risk") for r in (0, 1)])


@query("g1b_disagreements", O.with_layers(
    "l2", f"SELECT year, count(*) AS n_variants, CAST(sum(n) - max(n) AS BIGINT) AS n_other_rows FROM (SELECT year, sector_benchmark, {cols_sql(_MV[:3])}, "
          "count(*) AS n FROM l2 GROUP BY ALL) v GROUP BY year HAVING count(*) > 1"))
def g1b_disagreements(spark, sf_dir):
    """G1: years whose rows disagree on a macro (the sector benchmark does by
    design), and how many rows hold another value than the period table's."""
    return R.disagreements(l2(spark, sf_dir), ["sector_benchmark", *_MV[:3]])


@query("c14_macro_report", "SELECT * FROM (VALUES ('inflation', 'inflation', true), ('interest_rate', 'fed_rate', true), "
                           "('gdp_growth', 'gdp', true), ('stress', NULL, false)) t(series, column_name, found)")
def c14_macro_report(spark, sf_dir):
    """C14: macro series of the raw panel by candidate columns, the missing one reported."""
    return R.macro_report(raw(spark, sf_dir))


def _features(spark, sf_dir):
    return _analysis(spark, sf_dir).feature_names


def _matrix(spark, sf_dir):
    return _analysis(spark, sf_dir).matrix


def _boosted(spark, sf_dir) -> dict:
    """The boosted trees of both targets, grown in the same passes."""
    return _analysis(spark, sf_dir).models


# Fixed values of the twin: the model's features, and those that come once per regime.
_I9_NAMES = (
    "asset_turnover asset_turnover_lag1 asset_turnover_lag2 asset_turnover_rolling3 asset_turnover_trend capex_to_sales "
    "cash_rate_interaction cash_ratio cfo_to_assets cfo_to_sales current_ratio current_ratio_lag1 current_ratio_lag2 "
    "debt_ratio debt_ratio_lag1 debt_ratio_lag2 debt_ratio_rolling3 debt_ratio_trend debt_to_equity default_risk_triple "
    "distress_signal equity_ratio fed_rate firm_size firm_size_lag1 firm_size_lag2 gdp_efficiency_interaction gdp_growth "
    "gdp_leverage_interaction gross_margin inflation inflation_debt_interaction inflation_margin_interaction "
    "inflation_squeeze liquidity_crisis liquidity_gdp_interaction margin_rate_interaction market_fundamental_interaction "
    "operating_margin perfect_storm_risk pricing_power profit_margin_lag1 profit_margin_lag2 quick_ratio "
    "rate_debt_interaction rate_liquidity_interaction regime regime_confidence roa_lag1 roa_lag2 roa_volatility roe_lag1 "
    "roe_lag2 roe_rolling3 roe_trend rollover_risk sector_benchmark size_gdp_interaction size_volatility_interaction "
    "sp500 stress_intensity turnover_inflation_interaction volatility_debt_interaction")
_I9_PRODUCTS = ("asset_turnover current_ratio debt_ratio default_risk_triple distress_signal inflation_squeeze liquidity_crisis "
                "perfect_storm_risk pricing_power roe rollover_risk")


@query("i9_feature_list", CU.chained(
    O.layer_ctes("l2") + _L3_KM,
    "SELECT feature, (SELECT count(*) FROM l2 WHERE roa IS NOT NULL AND profit_margin IS NOT NULL) AS n_values FROM ("
    f"SELECT unnest(string_split('{_I9_NAMES}', ' ')) AS feature UNION ALL "
    "SELECT concat('regime_', label, '_dummy') FROM centres UNION ALL "
    f"SELECT concat(p, '_x_regime_', label) FROM centres, (SELECT unnest(string_split('{_I9_PRODUCTS}', ' ')) AS p)) f"))
def i9_feature_list(spark, sf_dir):
    """The model feature list (sorted) with each feature's non-null count."""
    m = _matrix(spark, sf_dir)
    feats = _features(spark, sf_dir)
    one = m.agg(*[F.count(c).alias(c) for c in feats])
    return one.unpivot([], feats, "feature", "n_values")


def _split_metrics(scored: DataFrame) -> DataFrame:
    """I12 for every target's ``predicted_`` column."""
    out = None
    for t in TARGETS:
        part = MD.metrics(scored, t, f"predicted_{t}")
        out = part if out is None else out.unionByName(part)
    return out


@query("i10_gbt_metrics")
def i10_gbt_metrics(spark, sf_dir):
    """Boosted trees per target; R2/RMSE/MAE per split."""
    return _split_metrics(BO.arrow_scorer(_boosted(spark, sf_dir))(_matrix(spark, sf_dir), TARGETS))


@query("i10c_rounds")
def i10c_rounds(spark, sf_dir):
    """Best and stop round of each target, and the validation errors there."""
    rows = [(t, m.best, m.grown, m.errors[m.best - 1] if m.errors else None, m.errors[-1] if m.errors else None)
            for t, m in _boosted(spark, sf_dir).items()]
    return spark.createDataFrame(rows, "target string, best_round int, stop_round int, best_rmse double, last_rmse double")


@query("i10d_round_rules", " UNION ALL ".join(
    f"SELECT '{t}' AS target, true AS stops_by_patience, true AS best_is_least, true AS leaves_hold_three" for t in TARGETS))
def i10d_round_rules(spark, sf_dir):
    """What holds of the rounds whatever the data: the last round is the
    best plus 30 or 300, the best has the least error, no leaf is under three rows."""
    rows = i10c_rounds(spark, sf_dir).select(
        "target", (F.col("stop_round") == F.least(F.lit(300), F.col("best_round") + 30)).alias("stops_by_patience"),
        F.coalesce(F.col("best_rmse") <= F.col("last_rmse"), F.lit(False)).alias("best_is_least"))
    leaves = BO.node_table(spark, list(_boosted(spark, sf_dir).values())).where("node > 0").groupBy("target").agg(
        F.every(F.col("n_rows") >= 3).alias("leaves_hold_three"))
    return rows.join(leaves, "target", "left").na.fill(True, ["leaves_hold_three"])


@query("i13_importance")
def i13_importance(spark, sf_dir):
    """Gain importances of each target's model, descending."""
    out = None
    for m in _boosted(spark, sf_dir).values():
        part = MD.importance_table(m, spark)
        out = part if out is None else out.unionByName(part)
    return out.orderBy("target", F.desc("importance"), "feature")


@query("i14_linear_baseline")
def i14_linear_baseline(spark, sf_dir):
    """Least-squares baseline vs boosted trees on the test split."""
    m, feats = _matrix(spark, sf_dir), _features(spark, sf_dir)
    test = BO.arrow_scorer(_boosted(spark, sf_dir))(m.where(F.col("split") == "test"), TARGETS)
    out = None
    for t in TARGETS:
        both = MD.predict(MD.train_linear(m, feats, t), test, feats, "lr_pred")
        y = F.col(t)
        a = both.agg(F.count(F.lit(1)).alias("n"), F.var_pop(y).alias("vy"),
                     F.sum((y - F.col("lr_pred")) ** 2).alias("sse_lr"),
                     F.sum((y - F.col(f"predicted_{t}")) ** 2).alias("sse_gbt"))
        part = a.select(
            F.lit(t).alias("target"),
            (1 - F.try_divide(F.col("sse_lr"), F.col("vy") * F.col("n"))).alias("lr_r2"),
            F.sqrt(F.col("sse_lr") / F.col("n")).alias("lr_rmse"),
            (1 - F.try_divide(F.col("sse_gbt"), F.col("vy") * F.col("n"))).alias("gbt_r2"),
            F.sqrt(F.col("sse_gbt") / F.col("n")).alias("gbt_rmse"))
        part = part.withColumn("rmse_improvement_pct",
                               (F.col("lr_rmse") - F.col("gbt_rmse")) / F.col("lr_rmse") * 100)
        out = part if out is None else out.unionByName(part)
    return out


@query("i16b_gbt_scored_panel")
def i16b_gbt_scored_panel(spark, sf_dir):
    """I16: every panel row scored by the boosted trees, with errors."""
    x = BO.arrow_scorer(_boosted(spark, sf_dir))(l3(spark, sf_dir), TARGETS)
    for t in TARGETS:
        x = MD.with_errors(x.withColumnRenamed(f"predicted_{t}", f"{t}_predicted"), t, f"{t}_predicted")
    return x.select("company", "year", *[c for t in TARGETS for c in (t, f"{t}_predicted", f"{t}_error",
                                                                       f"{t}_error_pct")])


# ------------------------------- small ensembles, trained again in SQL --
from . import trees as T  # noqa: E402

_SMALL = BO.BoostConfig(rounds=2, depth=2, row_share=1.0, column_share=1.0, patience=None, bins=8)
_SMALL_FEATS = ["asset_turnover", "current_ratio", "debt_ratio", "firm_size", "gross_margin", "liquidity_crisis", "roa_lag1",
                "stress_intensity"]
_SMALL_CTES = T.training_ctes(f"SELECT company, year, {', '.join(_SMALL_FEATS)}, roa AS y FROM l2 WHERE year <= 1999 AND roa IS NOT NULL",
                              _SMALL_FEATS)


def _small(spark, sf_dir) -> dict:
    key = (spark.sparkContext.applicationId, sf_dir, "small")
    if key not in _CACHE:
        rows = l2(spark, sf_dir).where("roa IS NOT NULL").withColumn("split", MD.split_col())
        _CACHE[key] = BO.train(rows, _SMALL_FEATS, ["roa"], _SMALL)
    return _CACHE[key]


@query("i10b_first_trees", O.with_layers(
    "l2", "SELECT e.tree, e.path, list_extract([" + ", ".join(f"'{f}'" for f in _SMALL_FEATS) + "], b.f) AS feature, b.cut AS threshold, "
          "e.value, CAST(e.n_rows AS BIGINT) AS n_rows, coalesce(b.gain, 0) AS gain FROM ends e LEFT JOIN best b ON e.tree = b.tree AND e.path = b.path",
    _SMALL_CTES))
def i10b_first_trees(spark, sf_dir):
    """Splits, gains, leaf values and row counts of two small trees, which
    SQL grows again from the panel."""
    model = _small(spark, sf_dir)["roa"]
    paths = []
    for t, tree in enumerate(model.trees):
        path = {0: ""}
        for i, (left, right) in enumerate(zip(tree.left, tree.right)):
            if left >= 0:
                path[left], path[right] = path[i] + "L", path[i] + "R"
        paths += [(t, i, p) for i, p in path.items()]
    names = spark.createDataFrame(paths, "tree int, node int, path string")
    return BO.node_table(spark, [model]).join(names, ["tree", "node"]).select(
        "tree", "path", "feature", "threshold", "value", "n_rows", "gain")


@query("i13b_small_importance", O.with_layers(
    "l2", "SELECT 'roa' AS target, feature, CASE WHEN sum(m) OVER () > 0 THEN m / sum(m) OVER () ELSE 0 END AS importance FROM ("
          "SELECT feature, CAST(coalesce(g.m, 0) AS DOUBLE) AS m FROM (SELECT unnest([" + ", ".join(f"'{f}'" for f in _SMALL_FEATS) + "]) AS feature, "
          f"unnest(range(1, {len(_SMALL_FEATS) + 1})) AS f) n LEFT JOIN (SELECT f, avg(gain) AS m FROM best GROUP BY f) g ON n.f = g.f) s",
    _SMALL_CTES))
def i13b_small_importance(spark, sf_dir):
    """I13 of the small trees: shares of the mean split gain."""
    return MD.importance_table(_small(spark, sf_dir)["roa"], spark)


_WALKED = _SMALL_CTES + T.predicted_ctes("l2", _SMALL_FEATS)


@query("i16c_tree_scored_panel", O.with_layers(
    "l2", "SELECT company, year, roa, predicted, roa - predicted AS error FROM walked", _WALKED))
def i16c_tree_scored_panel(spark, sf_dir):
    """I16 with the small trees: their Spark expression on every panel row."""
    x = BO.tree_scorer(_small(spark, sf_dir))(l2(spark, sf_dir), ["roa"])
    return x.select("company", "year", "roa", F.col("predicted_roa").alias("predicted"), (F.col("roa") - F.col("predicted_roa")).alias("error"))


_TREE_SC = _SC_CTES[:4] + _SMALL_CTES + T.predicted_ctes("fx", _SMALL_FEATS, "fxw") + [
    ("pred", "SELECT 'roa' AS target, scenario, company, coalesce(sector, 'Unknown') AS sector, predicted, debt_ratio, current_ratio FROM fxw"),
    _SC_CTES[5], ("risk", _RISK_SQL)]


def _small_pred(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, "pred", "small")
    if key not in _CACHE:
        _CACHE[key] = cut_lineage(S.score_scenarios(_latest(spark, sf_dir), S.baseline_macros(l2(spark, sf_dir)), ["roa"],
                                                    BO.arrow_scorer(_small(spark, sf_dir))))
    return _CACHE[key]


@query("j4d_tree_scenarios", O.with_layers("l2", "SELECT * FROM pred", _TREE_SC))
def j4d_tree_scenarios(spark, sf_dir):
    """J3/J4 with the small trees (Arrow scorer): firms x scenarios."""
    return _small_pred(spark, sf_dir)


@query("j6c_tree_risk_scores", O.with_layers("l2", "SELECT * FROM risk", _TREE_SC))
def j6c_tree_risk_scores(spark, sf_dir):
    """J6 with the small trees: risk scores per company."""
    return RK.risk_scores(S.base_vs_scenarios(_small_pred(spark, sf_dir)), RK.roa_history(l2(spark, sf_dir)))


@query("j4b_gbt_scenarios")
def j4b_gbt_scenarios(spark, sf_dir):
    """J3/J4 with the trained models: firms x scenarios rescored by GBT."""
    return _pred(spark, sf_dir, "trees").select("target", "scenario", "company", "sector", "predicted")


@query("j4c_gbt_invariants", O.with_layers("l2", " UNION ALL ".join(
    f"SELECT '{t}' AS target, count(DISTINCT company) AS n_firms, count(DISTINCT company) * {len(S.SCENARIOS)} AS n_rows, "
    f"{O.d(0.0)} AS base_gap, true AS scores_in_range, true AS ranks_gapless, "
    f"CAST({N_SIMS} AS BIGINT) AS n_draws FROM l2" for t in TARGETS)))
def j4c_gbt_invariants(spark, sf_dir):
    """What holds of the trained models' tables whatever the trees are: one
    row per firm and scenario, BASE equal to scoring the unshifted firms, risk
    scores in [0, 100], ranks 1 to n, one mean per draw."""
    panel, latest, scorer = _scored_by(spark, sf_dir, "trees")
    base, pred = S.baseline_macros(panel), _pred(spark, sf_dir, "trees")
    alone = scorer(S.update_macro_terms(latest, *[F.lit(base[v]) for v in S.NOISE_SD]), TARGETS).unpivot(
        "company", [f"predicted_{t}" for t in TARGETS], "target", "alone").withColumn(
        "target", F.regexp_replace("target", "^predicted_", ""))
    rows = pred.groupBy("target").agg(F.count_distinct("company").alias("n_firms"), F.count(F.lit(1)).alias("n_rows"))
    gap = pred.where("scenario = 'BASE'").join(alone, ["target", "company"]).groupBy("target").agg(
        F.round(F.max(F.abs(F.col("predicted") - F.col("alone"))), 9).alias("base_gap"))
    ranked = RK.risk_ranking(_risk(spark, sf_dir, "trees"))
    bounds = ranked.agg(F.every(F.col("risk_score").between(0, 100)).alias("scores_in_range"),
                        ((F.count_distinct("rank") == F.count(F.lit(1))) & (F.min("rank") == 1)
                         & (F.max("rank") == F.count(F.lit(1)))).alias("ranks_gapless"))
    draws = _boot(spark, sf_dir, "trees").groupBy("target").agg(F.count_distinct("sim_id").alias("n_draws"))
    return rows.join(gap, "target").join(draws, "target").select(
        "target", "n_firms", "n_rows", "base_gap", bounds.select("scores_in_range").scalar().alias("scores_in_range"),
        bounds.select("ranks_gapless").scalar().alias("ranks_gapless"), "n_draws")


@query("j5b_gbt_stress_impact")
def j5b_gbt_stress_impact(spark, sf_dir):
    """J5 with the trained models: mean impact of each scenario."""
    return S.stress_impacts(_wide(spark, sf_dir, "trees"))


@query("j6b_gbt_risk_scores")
def j6b_gbt_risk_scores(spark, sf_dir):
    """J6 with the trained models: risk scores per (target, company)."""
    return _risk(spark, sf_dir, "trees")


@query("j8c_gbt_bootstrap_means")
def j8c_gbt_bootstrap_means(spark, sf_dir):
    """J8 with the trained models: mean prediction of all firms per draw."""
    return _boot(spark, sf_dir, "trees")


@query("j8d_gbt_bootstrap_summary")
def j8d_gbt_bootstrap_summary(spark, sf_dir):
    """J8/J19 with the trained models: mean, std and intervals."""
    return S.bootstrap_summary(_boot(spark, sf_dir, "trees"))


@query("j9b_gbt_histogram")
def j9b_gbt_histogram(spark, sf_dir):
    """J9 with the trained models: 50-bin histogram of the draw means."""
    return S.histogram(_boot(spark, sf_dir, "trees"), 50)


@query("j10b_gbt_warnings")
def j10b_gbt_warnings(spark, sf_dir):
    """J10 with the trained models: warning signals."""
    return RK.by_drop(RK.warnings(_wide(spark, sf_dir, "trees")))


@query("j12b_gbt_risk_ranking")
def j12b_gbt_risk_ranking(spark, sf_dir):
    """J12 with the trained models: global risk ranking."""
    return RK.risk_ranking(_risk(spark, sf_dir, "trees"))


@query("j13c_gbt_sector_summary")
def j13c_gbt_sector_summary(spark, sf_dir):
    """J13 with the trained models: risk by sector."""
    return RK.sector_summary(_risk(spark, sf_dir, "trees"))


@query("h8b_gbt_sector_performance")
def h8b_gbt_sector_performance(spark, sf_dir):
    """H8 with the trained models: mean prediction by sector."""
    return RK.sector_performance(_pred(spark, sf_dir, "trees"))


@query("e14b_gbt_scenario_pivot")
def e14b_gbt_scenario_pivot(spark, sf_dir):
    """E14/J15/J16 with the trained models: scenario x target means."""
    return RK.scenario_pivot(_pred(spark, sf_dir, "trees"), TARGETS)


_LIN_FEATS = sorted({f for t in TARGETS for f, _ in S.LINEAR_SCORER[t][1]})


def _attr(spark, sf_dir, target, kind="trees", rows=None):
    """(wide attributions, features) of the given rows, all by default; those
    of all rows are written once."""
    feats = _features(spark, sf_dir) if kind == "trees" else _LIN_FEATS
    key = (spark.sparkContext.applicationId, sf_dir, "attr", kind, target)
    if rows is None and key in _CACHE:
        return _CACHE[key], feats
    if kind == "trees":
        p = l3(spark, sf_dir)
        wide = AT.attributions(MD.score_matrix(p if rows is None else rows(p), feats), _boosted(spark, sf_dir)[target], feats, target)
    else:
        p = l2(spark, sf_dir)
        wide = AT.linear_attributions(p if rows is None else rows(p), S.LINEAR_SCORER, feats, target, over=p)
    if rows is None:
        wide = _CACHE[key] = cut_lineage(wide)
    return wide, feats


def _attr_sql(target: str) -> str:
    return " UNION ALL ".join(
        f"SELECT company, year, '{target}' AS target, '{f}' AS feature, "
        + (f"{O.d(dict(S.LINEAR_SCORER[target][1])[f])} * (coalesce({f}, 0) - avg(coalesce({f}, 0)) OVER ())"
           if f in dict(S.LINEAR_SCORER[target][1]) else "CAST(0 AS DOUBLE)") + " AS contribution FROM l2" for f in _LIN_FEATS)


_ATTR = [(f"c_{t}", _attr_sql(t)) for t in TARGETS] + [
    (f"imp_{t}", f"SELECT target, feature, avg(abs(contribution)) AS importance FROM c_{t} GROUP BY target, feature") for t in TARGETS]


def _sample(df: DataFrame) -> DataFrame:
    """H6: at most 200 rows by a hash of the row's key and the seed, whatever
    the partitions."""
    order = F.md5(F.concat_ws(":", F.col("company"), F.col("year"), F.lit("42")))
    return df.orderBy(order, "company", "year").limit(200)


# Firms of the breakdown in order of preference.
_FIRMS = ["Supplier#000000007", "Supplier#000000001", "Supplier#000000002"]


@query("i18_attributions")
def i18_attributions(spark, sf_dir):
    """TreeSHAP contributions for every panel row and feature (ROA model)."""
    return AT.long_form(*_attr(spark, sf_dir, "roa"))


@query("i18b_local_accuracy")
def i18b_local_accuracy(spark, sf_dir):
    """I18 check: base + sum(contributions) vs the model's own prediction."""
    w, _ = _attr(spark, sf_dir, "roa")
    pr = BO.arrow_scorer(_boosted(spark, sf_dir))(l3(spark, sf_dir), ["roa"]).select("company", "year", "predicted_roa")
    j = w.join(pr, ["company", "year"])
    return j.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.max(F.abs(F.col("prediction") - F.col("predicted_roa"))).alias("max_abs_gap"))


@query("i18c_linear_attributions", O.with_layers("l2", "SELECT * FROM c_roa", _ATTR))
def i18c_linear_attributions(spark, sf_dir):
    """I18 with the linear scorer: contributions of every row and feature."""
    return AT.long_form(*_attr(spark, sf_dir, "roa", "linear"))


@query("i18d_tree_accuracy", O.with_layers("l2", "SELECT count(*) AS n_rows, CAST(0 AS DOUBLE) AS gap FROM l2"))
def i18d_tree_accuracy(spark, sf_dir):
    """Contributions and base value add up to the trees' prediction on
    every row (gap rounded to 9 digits)."""
    return i18b_local_accuracy(spark, sf_dir).select("n_rows", F.round("max_abs_gap", 9).alias("gap"))


def _importances(spark, sf_dir, kind, k=None):
    return [AT.global_importance(*_attr(spark, sf_dir, t, kind), k) for t in TARGETS]


@query("i19_global_importance")
def i19_global_importance(spark, sf_dir):
    """Mean |contribution| per feature, top 15, both targets."""
    return DataFrame.unionByName(*_importances(spark, sf_dir, "trees", 15))


@query("i19b_linear_importance", O.with_layers("l2", " UNION ALL ".join(
    f"SELECT * FROM (SELECT * FROM imp_{t} ORDER BY importance DESC, feature LIMIT 15) t" for t in TARGETS), _ATTR))
def i19b_linear_importance(spark, sf_dir):
    """I19/E10 with the linear scorer."""
    return DataFrame.unionByName(*_importances(spark, sf_dir, "linear", 15))


@query("i20_risk_drivers")
def i20_risk_drivers(spark, sf_dir):
    """Mean |negative contribution| per feature, top 10 (ROA)."""
    return AT.risk_drivers(*_attr(spark, sf_dir, "roa"), 10)


_DRIVERS = ("SELECT target, feature, avg(CASE WHEN contribution < 0 THEN -contribution END) AS mean_negative FROM c_roa "
            "GROUP BY target, feature HAVING mean_negative IS NOT NULL ORDER BY mean_negative DESC, feature LIMIT 10")


@query("i20b_linear_drivers", O.with_layers("l2", _DRIVERS, _ATTR))
def i20b_linear_drivers(spark, sf_dir):
    """I20/E10 with the linear scorer."""
    return AT.risk_drivers(*_attr(spark, sf_dir, "roa", "linear"), 10)


@query("e15_kpi_row", O.with_layers(
    "l2", "SELECT *, substr(top_sector, 1, 20) AS top_sector_label, (SELECT feature FROM (" + _DRIVERS + ") d LIMIT 1) AS top_driver "
          "FROM (SELECT count(*) AS n_rows, count(DISTINCT company) AS n_firms, "
          "count_if(risk_score >= 40) AS n_high, count_if(risk_score >= 60) AS n_critical, "
          "arg_min(company, (-risk_score, company)) AS top_firm, round_even(CAST(sum(CAST(risk_score AS DECIMAL(12, 2))) AS DOUBLE) / count(risk_score), 2) AS avg_risk FROM risk) a, "
          "(SELECT count_if(contains(warnings, 'HIGH LEVERAGE')) AS n_leverage_warnings, "
          "count_if(contains(warnings, 'LIQUIDITY CRISIS')) AS n_liquidity_warnings FROM warn) w, "
          "(SELECT arg_min(sector, (-m, sector)) AS top_sector FROM (SELECT sector, avg(risk_score) AS m "
          "FROM risk GROUP BY sector) s) s", _WARN_CTES + _ATTR))
def e15_kpi_row(spark, sf_dir):
    """One-row KPI summary."""
    return RK.kpi_row(_risk(spark, sf_dir), RK.warnings(_wide(spark, sf_dir)), i20b_linear_drivers(spark, sf_dir))


@query("e15b_gbt_kpi_row")
def e15b_gbt_kpi_row(spark, sf_dir):
    """E15 with the trained models: one-row KPI summary."""
    return RK.kpi_row(_risk(spark, sf_dir, "trees"), RK.warnings(_wide(spark, sf_dir, "trees")), i20_risk_drivers(spark, sf_dir))


def _breakdown(spark, sf_dir, kind):
    long = AT.long_form(*_attr(spark, sf_dir, "roa", kind, lambda p: AT.firm_row(p, _FIRMS)))
    return long.withColumn("file_name", F.concat(F.lit("waterfall_"), F.replace("company", F.lit(" "), F.lit("_"))))       # D27


@query("i21_firm_breakdown")
def i21_firm_breakdown(spark, sf_dir):
    """One firm's contributions (first listed firm present, first year);
    only its row is explained."""
    return _breakdown(spark, sf_dir, "trees")


@query("i21b_linear_breakdown", O.with_layers(
    "l2", "SELECT c.*, 'waterfall_' || replace(company, ' ', '_') AS file_name FROM c_roa c JOIN (SELECT company, year FROM l2 WHERE company IN (" + ", ".join(f"'{f}'" for f in _FIRMS)
          + ") ORDER BY list_position([" + ", ".join(f"'{f}'" for f in _FIRMS) + "], company), year LIMIT 1) f USING (company, year)", _ATTR))
def i21b_linear_breakdown(spark, sf_dir):
    """I21 with the linear scorer."""
    return _breakdown(spark, sf_dir, "linear")


@query("i22_importance_comparison")
def i22_importance_comparison(spark, sf_dir):
    """ROA vs profit-margin importances with ratios both ways, rows
    with a ratio over 1.5, largest first."""
    return AT.importance_comparison(*_importances(spark, sf_dir, "trees"))


@query("i22b_linear_comparison", O.with_layers(
    "l2", "SELECT * FROM (SELECT feature, a.importance AS importance_a, b.importance AS importance_b, "
          "a.importance / (b.importance + CAST('1e-08' AS DOUBLE)) AS ratio_a_over_b, "
          "b.importance / (a.importance + CAST('1e-08' AS DOUBLE)) AS ratio_b_over_a "
          "FROM imp_roa a JOIN imp_profit_margin b USING (feature)) r WHERE ratio_a_over_b > 1.5 OR ratio_b_over_a > 1.5", _ATTR))
def i22b_linear_comparison(spark, sf_dir):
    """I22/G4 with the linear scorer."""
    return AT.importance_comparison(*_importances(spark, sf_dir, "linear"))


@query("g9_top_in_other", O.with_layers(
    "l2", "SELECT a.feature, a.importance AS importance_a, coalesce(b.importance, 0) AS importance_b FROM "
          "(SELECT * FROM imp_roa ORDER BY importance DESC, feature LIMIT 10) a LEFT JOIN "
          "(SELECT * FROM imp_profit_margin WHERE importance > 0) b USING (feature)", _ATTR))
def g9_top_in_other(spark, sf_dir):
    """The ten most important ROA features looked up among those that the
    profit-margin scorer uses, 0 where it does not."""
    a, b = _importances(spark, sf_dir, "linear")
    return AT.top_in_other(a, b.where("importance > 0"))


def _dependence(spark, sf_dir, kind):
    wide, feats = _attr(spark, sf_dir, "roa", kind)
    names = [r["feature"] for r in AT.global_importance(wide, feats, 6).collect()]      # 6 names
    panel = l3(spark, sf_dir) if kind == "trees" else l2(spark, sf_dir)
    return AT.dependence_pairs(wide, feats, MD.score_matrix(panel, names), names)


@query("i23_dependence_pairs")
def i23_dependence_pairs(spark, sf_dir):
    """Value vs contribution for the top 6 ROA features."""
    return _dependence(spark, sf_dir, "trees")


@query("i23b_linear_dependence", O.with_layers(
    "l2", "SELECT company, year, 'roa' AS target, feature, CAST(value AS DOUBLE) AS value, contribution FROM c_roa JOIN ("
          + " UNION ALL ".join(f"SELECT company, year, '{f}' AS feature, coalesce({f}, 0) AS value FROM l2" for f in _LIN_FEATS)
          + ") v USING (company, year, feature) WHERE feature IN (SELECT feature FROM imp_roa ORDER BY importance DESC, feature LIMIT 6)", _ATTR))
def i23b_linear_dependence(spark, sf_dir):
    """I23 with the linear scorer."""
    return _dependence(spark, sf_dir, "linear")


# ------------------------------------------------ further inventory keys --

@query("a3_csv_sink", O.with_layers(
    "l2", f"SELECT *, row_number() OVER (ORDER BY risk_score DESC, company, target) AS rank, "
          f"{_LEVEL} AS risk_level FROM risk", _RISK_CTES))
def a3_csv_sink(spark, sf_dir):
    """A3: the risk ranking written as header CSV (no index column) under the
    checkpoint folder and read back with its schema."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..sources.sinks import write_csv
    ranking = RK.risk_ranking(_risk(spark, sf_dir))
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/csv/risk-ranking-{uuid.uuid4().hex}"
    write_csv(ranking, path, sort_cols=["rank"])
    return spark.read.schema(ranking.schema).option("header", True).csv(path)


_L1_NAMES = O.RAW_COLS + FE.layer1_new_columns()
_C10_FEATS = MD.feature_columns(_L1_NAMES, TARGETS, mode="clean")


@query("c10_model_matrix", O.with_layers(
    "l1", "SELECT company, year, " + _SPLIT_SQL + " AS split, " + ", ".join(TARGETS) + ", "
    + ", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in _C10_FEATS)
    + " FROM l1 WHERE " + " AND ".join(f"{t} IS NOT NULL" for t in TARGETS)))
def c10_model_matrix(spark, sf_dir):
    """Rows with every target, features filled with exact global
    medians, temporal split column."""
    m = MD.model_matrix(l1(spark, sf_dir), _C10_FEATS, TARGETS)
    return m.select("company", "year", "split", *TARGETS, *_C10_FEATS)


@query("e5_sector_map", O.with_layers(
    "l2", "SELECT company, arg_min(sector, CASE WHEN sector IS NOT NULL THEN year END) AS sector "
          "FROM l2 GROUP BY company"))
def e5_sector_map(spark, sf_dir):
    """E5: first (earliest non-null) sector per company."""
    return l2(spark, sf_dir).groupBy("company").agg(
        F.min_by("sector", F.when(F.col("sector").isNotNull(), F.col("year"))).alias("sector"))


@query("e13_fallback_risk", O.with_layers(
    "l2", "SELECT r.company, roa_mean, roa_std, debt_ratio, current_ratio, "
          f"least(greatest(debt_ratio * 100, {O.d(0.0)}), {O.d(100.0)}) AS risk_score, m.sector FROM "
          "(SELECT company, avg(roa) AS roa_mean, stddev_samp(roa) AS roa_std, avg(debt_ratio) AS debt_ratio, "
          "avg(current_ratio) AS current_ratio FROM l2 GROUP BY company) r LEFT JOIN "
          "(SELECT company, arg_min(sector, CASE WHEN sector IS NOT NULL THEN year END) AS sector "
          "FROM l2 GROUP BY company) m ON r.company = m.company"))
def e13_fallback_risk(spark, sf_dir):
    """Per-company roa mean/std, leverage and liquidity means,
    leverage-based score, sector mapped by a join."""
    p = l2(spark, sf_dir)
    r = p.groupBy("company").agg(F.avg("roa").alias("roa_mean"), F.stddev_samp("roa").alias("roa_std"),
                                 F.avg("debt_ratio").alias("debt_ratio"),
                                 F.avg("current_ratio").alias("current_ratio"))
    r = r.withColumn("risk_score", F.least(F.greatest(F.col("debt_ratio") * 100, F.lit(0.0)), F.lit(100.0)))
    m = e5_sector_map(spark, sf_dir)
    return r.join(m, "company", "left")


@query("g5_sector_impact", O.with_layers(
    "l2", "SELECT s.sector, s.m AS predicted_stress, b.m AS predicted_base, "
          f"(s.m - b.m) / greatest(abs(b.m), {O.d(0.001)}) * 100 AS impact_pct FROM "
          "(SELECT sector, avg(predicted) AS m FROM pred WHERE target = 'roa' AND scenario = 'STAGFLATION' GROUP BY sector) s "
          "JOIN (SELECT sector, avg(predicted) AS m FROM pred WHERE target = 'roa' AND scenario = 'BASE' GROUP BY sector) b "
          "ON s.sector = b.sector", _SC_CTES))
def g5_sector_impact(spark, sf_dir):
    """Stagflation vs base sector means (ROA), % impact, most negative first."""
    return RK.sector_impact(_pred(spark, sf_dir))


@query("g7_split_semijoin", O.with_layers(
    "l2", "SELECT company, year, roa FROM l2 WHERE year IN (SELECT DISTINCT year FROM l2 WHERE year <= 1999)"))
def g7_split_semijoin(spark, sf_dir):
    """Panel rows whose year is in the training-year list (left semi join
    against the distinct, bounded year list)."""
    p = l2(spark, sf_dir)
    years = p.select("year").where(F.col("year") <= 1999).distinct()
    if years.count() <= Q.MAX_YEARS:          # size-checked broadcast, shuffle beyond
        years = F.broadcast(years)
    return p.join(years, "year", "left_semi").select("company", "year", "roa")


@query("h3_negative_contributors")
def h3_negative_contributors(spark, sf_dir):
    """H3: per firm, latest year, the 5 most negative contributions below
    -0.001; only that row of each firm is explained."""
    return AT.negative_contributors(*_attr(spark, sf_dir, "roa", "trees", AT.latest_rows))


@query("h3b_linear_contributors", O.with_layers(
    "l2", "SELECT * FROM (SELECT c.*, CAST(row_number() OVER (PARTITION BY company ORDER BY contribution, feature) AS INTEGER) AS k "
          "FROM c_roa c JOIN (SELECT company, max(year) AS year FROM l2 GROUP BY company) m USING (company, year) "
          "WHERE contribution < -0.001) r WHERE k <= 5", _ATTR))
def h3b_linear_contributors(spark, sf_dir):
    """H3 with the linear scorer."""
    return AT.negative_contributors(*_attr(spark, sf_dir, "roa", "linear", AT.latest_rows))


@query("h6_attribution_sample")
def h6_attribution_sample(spark, sf_dir):
    """A seeded sample of min(200, rows) panel rows (hash order, so it
    does not depend on partitioning) and their contributions."""
    return AT.long_form(*_attr(spark, sf_dir, "roa", "trees", _sample))


@query("h6b_linear_sample", O.with_layers(
    "l2", "SELECT c.* FROM c_roa c JOIN (SELECT company, year FROM l2 ORDER BY md5(concat_ws(':', company, year, '42')), company, year "
          "LIMIT 200) s USING (company, year)", _ATTR))
def h6b_linear_sample(spark, sf_dir):
    """H6/I18 with the linear scorer: the same sample."""
    return AT.long_form(*_attr(spark, sf_dir, "roa", "linear", _sample))


def _fallback(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, "fallback")
    if key not in _CACHE:
        _CACHE[key] = cut_lineage(MD.fallback_matrix(l3(spark, sf_dir), TARGETS))
    return _CACHE[key]


@query("h7_median_split", O.with_layers(
    "l2", "SELECT split, y AS split_year, count(*) AS n_rows, min(year) AS first_year, max(year) AS last_year FROM ("
          "SELECT year, y, CASE WHEN year < y THEN 'train' ELSE 'test' END AS split FROM l2, "
          "(SELECT list_sort(list(DISTINCT year))[CAST(floor(count(DISTINCT year) / 2) AS INTEGER) + 1] AS y FROM l2) s) r GROUP BY split, y"))
def h7_median_split(spark, sf_dir):
    """H7: rows before the middle year against the others."""
    return MD.median_year_split(l2(spark, sf_dir)).groupBy("split", "split_year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@query("i11_fallback_gbt")
def i11_fallback_gbt(spark, sf_dir):
    """Fallback trainer: 200 trees of depth 5 on the rows before the
    median year, all numeric columns but the excluded ones, no validation."""
    m = _fallback(spark, sf_dir)
    models = BO.train(m, MD.fallback_features(m.drop("split_year")), TARGETS, BO.FALLBACK)
    return _split_metrics(BO.arrow_scorer(models)(m, TARGETS))


# The fallback trainer and the least-squares baseline on few features, fitted again in SQL.
_FEW = ", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in _SMALL_FEATS)
_KNOWN_SQL = f"SELECT company, year, roa, profit_margin, {_FEW} FROM l2 WHERE roa IS NOT NULL AND profit_margin IS NOT NULL"


def _fit_sql(rows: str, target: str, actual: str, predicted: str) -> str:
    """I12 over a CTE: R2, RMSE and MAE per split."""
    err = f"({actual} - {predicted})"
    return (f"SELECT '{target}' AS target, split, count(*) AS n, 1 - sum({err} * {err}) / nullif(var_pop({actual}) * count(*), 0) AS r2, "
            f"sqrt(sum({err} * {err}) / count(*)) AS rmse, avg(abs({err})) AS mae FROM {rows} GROUP BY split")


_FALLBACK_CTES = [
    ("known", _KNOWN_SQL),
    ("mid", "SELECT list_sort(list(DISTINCT year))[CAST(floor(count(DISTINCT year) / 2) AS INTEGER) + 1] AS y0 FROM known"),
    ("halves", "SELECT known.*, CASE WHEN year < y0 THEN 'train' ELSE 'test' END AS split FROM known, mid"),
    *T.training_ctes(f"SELECT company, year, {', '.join(_SMALL_FEATS)}, roa AS y FROM halves WHERE split = 'train'", _SMALL_FEATS),
    *T.predicted_ctes("halves", _SMALL_FEATS)]


@query("i11b_small_fallback", O.with_layers("l2", _fit_sql("walked", "roa", "roa", "predicted"), _FALLBACK_CTES))
def i11b_small_fallback(spark, sf_dir):
    """I11 with two small trees: the fallback's rows, median fills, excluded
    columns and middle-year split."""
    few = l2(spark, sf_dir).select("company", "year", "sector", *TARGETS, "roe", "gdp_growth", *_SMALL_FEATS)
    m = cut_lineage(MD.fallback_matrix(few))
    feats = MD.fallback_features(m.drop("split_year"))
    models = BO.train(m, feats, ["roa"], replace(_SMALL, seed=BO.FALLBACK.seed))
    return MD.metrics(BO.arrow_scorer(models)(m, ["roa"]), "roa", "predicted_roa")


_LEAST_FEATS = ["debt_ratio", "roa_lag1"]


def _plane_ctes(target: str) -> list[tuple[str, str]]:
    """Least squares on two features in closed form, by covariances."""
    a, b = _LEAST_FEATS
    return [
        (f"cov_{target}", f"SELECT avg({target}) AS my, avg({a}) AS ma, avg({b}) AS mb, var_pop({a}) AS va, var_pop({b}) AS vb, "
                          f"covar_pop({a}, {b}) AS cab, covar_pop({a}, {target}) AS cay, covar_pop({b}, {target}) AS cby FROM parts WHERE split = 'train'"),
        (f"plane_{target}", "SELECT *, (cay * vb - cby * cab) / (va * vb - cab * cab) AS wa, "
                            f"(cby * va - cay * cab) / (va * vb - cab * cab) AS wb FROM cov_{target}"),
        (f"on_{target}", f"SELECT split, {target} AS actual, my + wa * ({a} - ma) + wb * ({b} - mb) AS predicted FROM parts, plane_{target}")]


@query("i14b_least_squares", O.with_layers(
    "l2", " UNION ALL ".join(_fit_sql(f"on_{t}", t, "actual", "predicted") for t in TARGETS),
    [("parts", f"SELECT *, {_SPLIT_SQL} AS split FROM ({_KNOWN_SQL}) k"), *(c for t in TARGETS for c in _plane_ctes(t))]))
def i14b_least_squares(spark, sf_dir):
    """I14/I12 on two features: the least-squares baseline per target and split."""
    m = cut_lineage(MD.model_matrix(l2(spark, sf_dir).select("company", "year", *TARGETS, *_LEAST_FEATS), _LEAST_FEATS))
    out = None
    for t in TARGETS:
        part = MD.metrics(MD.predict(MD.train_linear(m, _LEAST_FEATS, t), m, _LEAST_FEATS, "fitted"), t, "fitted")
        out = part if out is None else out.unionByName(part)
    return out
