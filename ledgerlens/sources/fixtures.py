"""Fixture panels derived from the driver tables.

The reference reads one company x year sheet.  Our test panels are built from
the TPC-H-like tables with one SQL text that runs unchanged in Spark SQL and in
DuckDB, so that every downstream operator can be checked against a DuckDB twin.
Spark receives the tables as DataFrame arguments (no global temp views).

* Panel A: company = supplier, sector = region, year = ship year (balanced).
* Panel B: company = customer, sector = market segment (unbalanced).
* Fixture C: one row per order month, four measures (clustering input).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

# The annual macro table of the fixture (year, inflation,
# fed_rate, gdp, sp500).  It sits on many band edges on purpose.
MACRO_ROWS = (
    (1995, 2.5, 5.5, 2.7, 20.0), (1996, 1.5, 3.0, 3.9, 11.0),
    (1997, -0.5, 0.5, -2.6, -20.0), (1998, 6.2, 4.6, -0.4, -5.0),
    (1999, 8.0, 5.2, 1.1, 3.0), (2000, 4.0, 2.0, 2.0, 8.0),
    (2001, 0.0, 0.25, 0.0, 1.0),
)

_MACRO_VALUES = ", ".join(
    "(%d, %s, %s, %s, %s)" % r for r in MACRO_ROWS)

PANEL_A_SQL = """
WITH macro(year, inflation, fed_rate, gdp, sp500) AS (VALUES %s),
flow AS (
  SELECT l_suppkey AS k, CAST(year(l_shipdate) AS INT) AS year,
         sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(4,2))) AS sales,
         sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.7 AS DECIMAL(4,2))) AS cost,
         sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS tax,
         sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END) AS returned,
         sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE CAST(0 AS DECIMAL(12,2)) END) AS open_amt,
         sum(CAST(l_quantity AS BIGINT)) AS qty
  FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate))
SELECT s.s_name AS company, f.year AS year, r.r_name AS sector,
       CAST(f.sales AS DOUBLE)          AS net_sales,
       CAST(f.sales - f.cost AS DOUBLE) AS gross_profit,
       CAST(f.sales - f.cost - f.tax AS DOUBLE)                AS operating_income,
       CAST(f.sales - f.cost - f.tax - f.returned * CAST(0.25 AS DECIMAL(4,2)) AS DOUBLE) AS net_income,
       CAST(f.sales + f.open_amt + 1000 AS DOUBLE)             AS total_assets,
       CAST(f.cost + f.tax AS DOUBLE)                          AS total_liabilities,
       CAST(f.sales + f.open_amt + 1000 - f.cost - f.tax AS DOUBLE) AS equity,
       CAST(f.open_amt + f.returned AS DOUBLE)                 AS current_assets,
       CAST(f.returned AS DOUBLE)                              AS inventories,
       CASE WHEN (s.s_suppkey + f.year) %% 23 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(f.cost AS DOUBLE) / 3 END AS current_liabilities,
       CASE WHEN (s.s_suppkey * 7 + f.year * 3) %% 10 < 6 THEN NULL ELSE CAST(f.qty AS DOUBLE) END       AS marketable_securities,
       CASE WHEN (s.s_suppkey * 5 + f.year) %% 12 = 0 OR s.s_suppkey %% 17 = 0 THEN NULL ELSE CAST(f.qty * 3 AS DOUBLE) END AS cash,
       CASE WHEN (s.s_suppkey + f.year * 11) %% 16 = 0 THEN NULL ELSE CAST(f.qty AS DOUBLE) / 100 + 10 END AS stock_price,
       CAST(f.sales - f.cost - f.returned AS DOUBLE)           AS cfo,
       CAST(0 - f.tax AS DOUBLE)                               AS capex,
       CAST(m.inflation AS DOUBLE) AS inflation, CAST(m.fed_rate AS DOUBLE) AS fed_rate,
       CAST(m.gdp AS DOUBLE) AS gdp, CAST(m.sp500 AS DOUBLE) AS sp500,
       CAST(m.sp500 + length(r.r_name) AS DOUBLE) AS sector_benchmark
FROM flow f JOIN {supplier} s ON f.k = s.s_suppkey
            JOIN {nation} n ON s.s_nationkey = n.n_nationkey
            JOIN {region} r ON n.n_regionkey = r.r_regionkey
            JOIN macro m ON f.year = m.year
""" % _MACRO_VALUES

PANEL_B_SQL = """
SELECT c.c_name AS company, CAST(year(o.o_orderdate) AS INT) AS year, c.c_mktsegment AS sector,
       CAST(sum(CAST(o.o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS net_sales,
       count(*) AS n_orders, c.c_acctbal AS acctbal
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
GROUP BY c.c_name, CAST(year(o.o_orderdate) AS INT), c.c_mktsegment, c.c_acctbal
"""

MONTHS_C_SQL = """
SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT) AS period,
       CAST(count(*) AS DOUBLE) AS n_orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / count(*) AS avg_price,
       CAST(sum(CASE WHEN o_orderpriority LIKE '1%%' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS urgent_share,
       CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS finished_share
FROM {orders} GROUP BY CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT)
""".replace("%%", "%")

# Measures of panel A, in schema order.
PANEL_A_MEASURES = (
    "net_sales", "gross_profit", "operating_income", "net_income",
    "total_assets", "total_liabilities", "equity", "current_assets",
    "inventories", "current_liabilities", "marketable_securities", "cash",
    "stock_price", "cfo", "capex", "inflation", "fed_rate", "gdp", "sp500",
    "sector_benchmark")

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def duckdb_sql(template: str) -> str:
    """The same text with table placeholders replaced by plain view names."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), template)


def _run(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    names = sorted(set(_PLACEHOLDER.findall(template)))
    frames = {n: read_table(spark, sf_dir, n) for n in names}
    return spark.sql(template, **frames)


def panel_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw company x year panel (fixture A), one row per (company, year)."""
    return _run(spark, sf_dir, PANEL_A_SQL)


def panel_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbalanced customer x year panel (fixture B)."""
    return _run(spark, sf_dir, PANEL_B_SQL)


def months_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month x measure table for clustering (fixture C)."""
    return _run(spark, sf_dir, MONTHS_C_SQL)
