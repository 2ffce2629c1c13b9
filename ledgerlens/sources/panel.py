"""Reading a user's panel (A1, C7): declared types, nothing silently lost.

The file's own columns decide what is read: known names get their declared
type, missing ones are reported, others are left out.  A line that does not
parse goes to ``rejected`` with its text; NaN and infinities become NULL; a
(company, year) that occurs more than once is listed, and one of its rows
kept: the one with most values, then the least.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.exprs import null_if_nonfinite
from ..session import cut_lineage

# The named measures of a panel, in report order.
MEASURES = (
    "net_sales", "cost_of_sales", "gross_profit", "operating_income", "interest_income", "interest_expense",
    "other_income", "pretax_income", "income_tax", "net_income", "eps_diluted", "diluted_shares", "cfo", "capex",
    "acquisitions", "cfi", "debt_issuance", "debt_repayment", "share_buybacks", "dividends_paid", "cff",
    "net_change_in_cash", "depreciation", "stock_compensation", "working_capital_change", "cash",
    "accounts_receivable", "inventories", "other_current_assets", "current_assets", "ppe_net", "goodwill",
    "other_long_term_assets", "total_assets", "accounts_payable", "accrued_liabilities", "other_current_liabilities",
    "current_liabilities", "long_term_debt", "other_long_term_liabilities", "total_liabilities", "equity",
    "operating_expenses", "marketable_securities", "other_investing_activities", "other_financing_activities",
    "stock_price", "sector_benchmark", "inflation", "fed_rate", "gdp", "sp500")
KEY = ("company", "year")
PANEL = StructType([StructField("company", StringType()), StructField("year", IntegerType()), StructField("sector", StringType()),
                    *[StructField(m, DoubleType()) for m in MEASURES]])
LINE = "_line"


@dataclass
class Panel:
    """A panel as read: one row a key, and what was found on the way."""
    rows: DataFrame             # declared columns that the file has
    rejected: DataFrame         # (line): lines that do not parse
    repeated: DataFrame         # (company, year, n_rows): keys on several rows
    missing: list[str]          # declared columns that the file lacks


def _typed(path_columns: list[str]) -> StructType:
    known = {f.name: f for f in PANEL}
    return StructType([known.get(c, StructField(c, StringType())) for c in path_columns])


def read_panel(spark: SparkSession, path: str, kind: str = "csv") -> Panel:
    """A panel from CSV with a header, or from parquet."""
    if kind == "parquet":
        found = spark.read.parquet(path)
        typed = {f.name: F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") for f in _typed(found.columns)}
        broken = F.lit(False)                       # a value that does not convert breaks its row
        for name, value in typed.items():
            broken = broken | (F.col(f"`{name}`").isNotNull() & value.isNull())
        return _checked(found.where(~broken).select(*[v.alias(n) for n, v in typed.items()]),
                        found.where(broken).select(F.to_json(F.struct("*")).alias("line")))
    if kind != "csv":
        raise ValueError(f"unknown panel format {kind!r}")
    header = spark.read.option("header", True).csv(path).columns
    schema = StructType([*_typed(header), StructField(LINE, StringType())])
    read = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", LINE).option("positiveInf", "inf").option("negativeInf", "-inf").csv(path))
    # written once with all columns: a scan of fewer would not see every line that does not parse
    read = cut_lineage(read)
    return _checked(read.where(F.col(LINE).isNull()).drop(LINE), read.where(F.col(LINE).isNotNull()).select(F.col(LINE).alias("line")))


def _checked(read: DataFrame, rejected: DataFrame) -> Panel:
    have = [f for f in PANEL if f.name in read.columns]
    rows = read.select(*[null_if_nonfinite(f.name).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in have])
    measures = [f.name for f in have if f.name not in KEY]
    repeated = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    if measures:
        filled = sum((F.col(m).isNotNull().cast("int") for m in measures), F.lit(0))
        best = F.struct((-filled).alias("n"), *measures)
        rows = rows.groupBy(*KEY).agg(F.min_by(F.struct(*measures), best).alias("r")).select(*KEY, "r.*").select(*[f.name for f in have])
    else:
        rows = rows.distinct()
    return Panel(rows, rejected, repeated, [f.name for f in PANEL if f.name not in read.columns])
