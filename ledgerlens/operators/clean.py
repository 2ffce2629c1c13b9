"""Cleaning and imputation.

All per-company work shares one ``(company) ORDER BY year`` window so the
planner shuffles and sorts the panel once per stage; median fills are one
aggregate + one join for all columns of a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import numeric_columns
from ..functions.stats import fill_with_medians
from ..session import cut_lineage

KEY, TIME, GROUP = "company", "year", "sector"

# Cleaning plan of the analysed pipeline, in our column names.
DROP_COLUMNS = ["other_financing_activities", "other_investing_activities"]
# column -> share of cash used as the last-resort fill
MODERATE_COLUMNS = {"marketable_securities": 0.15, "interest_income": 0.025}
INTERPOLATE_COLUMNS = [
    "other_income", "operating_expenses", "acquisitions", "debt_repayment",
    "stock_based_compensation", "other_current_assets", "other_long_term_assets",
    "accrued_liabilities", "other_long_term_liabilities", "eps_diluted",
    "diluted_shares", "proceeds_from_debt", "share_buybacks", "dividends_paid",
    "net_change_in_cash", "changes_in_working_capital", "accounts_payable",
    "other_current_liabilities", "sector_benchmark", "goodwill", "stock_price"]


def company_window(key: str = KEY, order: str = TIME) -> Window:
    return Window.partitionBy(key).orderBy(order)


def drop_columns(df: DataFrame, cols=DROP_COLUMNS) -> DataFrame:
    """Drop listed columns when present."""
    return df.drop(*[c for c in cols if c in df.columns])


def interpolate(df: DataFrame, cols: list[str], key: str = KEY, order: str = TIME) -> DataFrame:
    """Linear interpolation per company in row-position steps, both
    directions: inner gaps are interpolated, leading nulls take the first
    value and trailing nulls the last; an all-null company stays null."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    w = company_window(key, order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fwd = w.rowsBetween(0, Window.unboundedFollowing)
    pos = F.row_number().over(w)
    staged = df.withColumn("__pos", pos)
    exprs = {}
    for c in cols:
        p_nn = F.when(F.col(c).isNotNull(), F.col("__pos"))
        exprs[f"__pv_{c}"] = F.last(F.col(c), ignorenulls=True).over(back)
        exprs[f"__pp_{c}"] = F.last(p_nn, ignorenulls=True).over(back)
        exprs[f"__nv_{c}"] = F.first(F.col(c), ignorenulls=True).over(fwd)
        exprs[f"__np_{c}"] = F.first(p_nn, ignorenulls=True).over(fwd)
    staged = staged.withColumns(exprs)
    out = {}
    for c in cols:
        pv, pp, nv, np_ = (F.col(f"__pv_{c}"), F.col(f"__pp_{c}"),
                           F.col(f"__nv_{c}"), F.col(f"__np_{c}"))
        step = (nv - pv) / (np_ - pp).cast("double")
        inner = pv + step * (F.col("__pos") - pp).cast("double")
        out[c] = (F.when(F.col(c).isNotNull(), F.col(c))
                   .when(pv.isNotNull() & nv.isNotNull(), inner)
                   .otherwise(F.coalesce(pv, nv)))
    return staged.withColumns(out).select(*df.columns)


def fill_group_median(df: DataFrame, cols: list[str], keys: list[str],
                      hot: bool = True) -> DataFrame:
    """Fill nulls with the median of the same (sector, year) group.
    Groups may be hot (a sector can hold a third of the rows), so the exact
    radix-select median is used.  A null group key gets no fill (pandas)."""
    return fill_with_medians(df, keys, [c for c in cols if c in df.columns], hot=hot)


def fill_from_related(df: DataFrame, col: str, source: str, share: float) -> DataFrame:
    """C4: ``coalesce(col, source * share)``."""
    if col not in df.columns or source not in df.columns:
        return df
    return df.withColumn(col, F.coalesce(F.col(col), F.col(source) * F.lit(share)))


def fill_company_then_global(df: DataFrame, cols: list[str], key: str = KEY,
                             checkpoint: bool = True) -> DataFrame:
    """Company median, then the global median of the company-filled
    column.  Company groups are bounded (one row per year); the global median
    is the distributed radix select, whose input is checkpointed because it
    is read three times."""
    cols = [c for c in cols if c in df.columns]
    step = fill_with_medians(df, [key], cols)
    if checkpoint:
        step = cut_lineage(step)
    return fill_with_medians(step, [], cols)


def clean_panel(df: DataFrame, cash_col: str = "cash", checkpoint: bool = True) -> DataFrame:
    """Layer 0: drop, interpolate + sector-year median + related fill for the
    moderate columns, interpolate the rest, then company/global medians over
    every numeric column."""
    df = drop_columns(df)
    moderate = [c for c in MODERATE_COLUMNS if c in df.columns]
    df = interpolate(df, moderate + [c for c in INTERPOLATE_COLUMNS if c in df.columns])
    if checkpoint:
        df = cut_lineage(df)
    df = fill_group_median(df, moderate, [GROUP, TIME])
    for c in moderate:
        df = fill_from_related(df, c, cash_col, MODERATE_COLUMNS[c])
    return fill_company_then_global(df, numeric_columns(df, exclude=(TIME,)), checkpoint=checkpoint)
