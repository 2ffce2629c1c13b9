"""Profiling and data-quality operators.

Every whole-table statistic is a single aggregate pass (one row of partial
sums per task, merged once), unpivoted afterwards, so the cost is one scan no
matter how many columns are profiled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import numeric_columns
from ..functions.stats import hot_quantiles_by, pair_corr

# Largest distinct-year domain we accept as a driver-side literal list.
MAX_YEARS = 10_000


def _unpivot_one_row(row_df: DataFrame, names: list[str], value_name: str,
                     var_name: str = "column_name") -> DataFrame:
    return row_df.unpivot([], names, var_name, value_name)


def schema_summary(df: DataFrame) -> DataFrame:
    """B1: one row a column: position, name, type, whether it is numeric,
    beside the table's row and column counts."""
    numeric = set(numeric_columns(df))
    rows = [(i, f.name, f.dataType.simpleString(), f.name in numeric) for i, f in enumerate(df.schema.fields)]
    cols = df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string, is_numeric boolean")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return cols.withColumns({"n_rows": n, "n_cols": F.lit(len(rows)), "n_numeric": F.lit(len(numeric))})


def null_totals(df: DataFrame) -> DataFrame:
    """B2: total cells, total nulls and overall null percentage."""
    cols = df.columns
    per = [F.sum(F.col(c).isNull().cast("long")) for c in cols]
    total_nulls = per[0]
    for e in per[1:]:
        total_nulls = total_nulls + e
    n = F.count(F.lit(1))
    return df.agg((n * len(cols)).alias("total_cells"),
                  total_nulls.alias("total_nulls")).select(
        "total_cells", "total_nulls",
        F.round(F.col("total_nulls") * 100.0 / F.col("total_cells"), 6).alias("null_pct"))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null count and share per column, long form (column_name, missing_count, missing_pct)."""
    cols = cols or df.columns
    one = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    long = one.unpivot(["__n"], cols, "column_name", "missing_count")
    return long.select("column_name", "missing_count",
                       F.round(F.col("missing_count") * 100.0 / F.col("__n"), 6).alias("missing_pct"))


def nulls_by_column(df: DataFrame) -> DataFrame:
    """Per-column nulls, only columns with any, by share descending."""
    return (null_counts(df).where(F.col("missing_count") > 0)
            .orderBy(F.desc("missing_pct"), "column_name"))


def key_nulls(df: DataFrame, keys=("year", "company", "sector")) -> DataFrame:
    """Null counts of the key columns."""
    return df.agg(*[F.count_if(F.col(k).isNull()).alias(f"{k}_nulls") for k in keys])


def nulls_by_group(df: DataFrame, keys=("company", "year", "sector")) -> DataFrame:
    """Nulls over all columns per company, per year and per sector in one
    pass with GROUPING SETS.  Null group keys are dropped (pandas groupby)."""
    n_null = None
    for c in df.columns:
        e = F.col(c).isNull().cast("long")
        n_null = e if n_null is None else n_null + e
    base = df.select(*[F.col(k).cast("string").alias(k) for k in keys], n_null.alias("n_null"))
    g = base.groupingSets([[k] for k in keys], *keys).agg(
        F.sum("n_null").alias("n_null"), F.grouping_id().alias("gid"))
    n = len(keys)
    level = None
    for i, k in enumerate(keys):
        gid_k = (1 << n) - 1 - (1 << (n - 1 - i))   # only key k is grouped
        cond = F.col("gid") == gid_k
        level = F.when(cond, F.lit(k)) if level is None else level.when(cond, F.lit(k))
    key = F.coalesce(*[F.col(k) for k in keys])
    out = g.select(level.alias("level"), key.alias("group_key"), "n_null")
    return out.where(F.col("group_key").isNotNull()).orderBy("level", F.desc("n_null"), "group_key")


def panel_balance(df: DataFrame) -> DataFrame:
    """Distinct companies x distinct years vs rows."""
    a = df.agg(F.count_distinct("company").alias("n_companies"),
               F.count_distinct("year").alias("n_years"),
               F.count(F.lit(1)).alias("n_rows"))
    exp = F.col("n_companies") * F.col("n_years")
    return a.select("n_companies", "n_years", exp.alias("expected_rows"), "n_rows",
                    (exp - F.col("n_rows")).alias("missing_pairs"),
                    (exp == F.col("n_rows")).alias("balanced"))


def missing_pairs(df: DataFrame) -> DataFrame:
    """The (company, year) pairs absent from the panel.

    The distinct years are a scalar subquery, so each company's gaps are
    ``array_except`` of its own years: no cross join, no driver list, one
    shuffle by company."""
    all_years = df.agg(F.sort_array(F.collect_set("year")).alias("years")).scalar()
    per = (df.where(F.col("company").isNotNull() & F.col("year").isNotNull())
             .groupBy("company").agg(F.collect_set("year").alias("have")))
    return (per.select("company", F.explode(F.array_except(all_years, F.col("have"))).alias("year"))
               .orderBy("company", "year"))


def null_report(df: DataFrame, names: list[str]) -> DataFrame:
    """Null report over a named list; absent columns report NULL ('N/A'),
    plus a TOTAL row over the present ones."""
    present = [c for c in names if c in df.columns]
    counts = null_counts(df, present) if present else None
    spark = df.sparkSession
    lst = spark.createDataFrame([(i, c) for i, c in enumerate(names)],
                                "position int, column_name string")
    body = lst.join(counts, "column_name", "left") if counts is not None else lst.select(
        "position", "column_name", F.lit(None).cast("long").alias("missing_count"),
        F.lit(None).cast("double").alias("missing_pct"))
    body = body.select("position", "column_name", "missing_count", "missing_pct",
                       F.col("missing_count").isNotNull().alias("present"))
    n = df.count() if present else 0
    tot = body.agg(F.sum("missing_count").alias("missing_count")).select(
        F.lit(len(names)).alias("position"), F.lit("TOTAL").alias("column_name"),
        "missing_count",
        F.round(F.col("missing_count") * 100.0 / F.lit(max(n * len(present), 1)), 6).alias("missing_pct"),
        F.lit(True).alias("present"))
    return body.unionByName(tot).orderBy("position")


def null_indicator_corr(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation matrix of null indicators (long form)."""
    ind = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in cols])
    pairs = [(a, b) for a in cols for b in cols]
    one = ind.agg(*[F.round(pair_corr(a, b), 9).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    return long.select(F.split("pair", r"\|").getItem(0).alias("col_a"),
                       F.split("pair", r"\|").getItem(1).alias("col_b"), "corr")


def describe(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    """Count, mean, std, min, quartiles, max per column, rounded.
    Quartiles are exact (radix select), never ``df.summary``'s approximations."""
    one = df.agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}|count"), F.avg(c).alias(f"{c}|mean"),
        F.stddev_samp(c).alias(f"{c}|std"), F.min(c).alias(f"{c}|min"),
        F.max(c).alias(f"{c}|max"))])
    stats = ("count", "mean", "std", "min", "max")
    long = one.unpivot([], [f"{c}|{s}" for c in cols for s in stats], "k", "value")
    long = long.select(F.split("k", r"\|").getItem(0).alias("column_name"),
                       F.split("k", r"\|").getItem(1).alias("stat"), "value")
    wide = long.groupBy("column_name").pivot("stat", list(stats)).agg(F.first("value"))
    q = hot_quantiles_by(df, [], cols, [0.25, 0.5, 0.75]).select(
        F.col("col").alias("column_name"), F.col("q_0").alias("p25"),
        F.col("q_1").alias("p50"), F.col("q_2").alias("p75"))
    out = wide.join(q, "column_name", "left")
    r = lambda c: F.round(F.col(c).cast("double"), digits).alias(c)
    return out.select("column_name", F.col("count").cast("long").alias("count"),
                      r("mean"), r("std"), r("min"), r("p25"), r("p50"), r("p75"), r("max"))


def ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min / max / mean per column, long form."""
    one = df.agg(*[e for c in cols for e in (
        F.min(c).alias(f"{c}|min"), F.max(c).alias(f"{c}|max"), F.avg(c).alias(f"{c}|mean"))])
    long = one.unpivot([], [f"{c}|{s}" for c in cols for s in ("min", "max", "mean")], "k", "v")
    long = long.select(F.split("k", r"\|").getItem(0).alias("column_name"),
                       F.split("k", r"\|").getItem(1).alias("stat"), "v")
    return long.groupBy("column_name").pivot("stat", ["min", "max", "mean"]).agg(F.first("v"))


def feature_availability(df: DataFrame, requirements: dict[str, list[str]]) -> DataFrame:
    """Per layer, how many required columns the table's schema has and
    which are missing (a column without any value is there)."""
    spark = df.sparkSession
    have = spark.createDataFrame([(c,) for c in df.columns], "have string")
    req = spark.createDataFrame([(layer, c) for layer, cs in requirements.items() for c in cs], "layer string, column_name string")
    req = req.join(F.broadcast(have), F.col("column_name") == F.col("have"), "left")            # one row a column
    return req.groupBy("layer").agg(
        F.count("have").alias("available"), F.count(F.lit(1)).alias("required"),
        F.array_sort(F.collect_list(F.when(F.col("have").isNull(), F.col("column_name")))).alias("missing"))


def clean_gate(df: DataFrame) -> DataFrame:
    """Nulls remaining after cleaning; clean when zero."""
    t = null_totals(df)
    return t.select(F.col("total_nulls").alias("remaining_nulls"),
                    (F.col("total_nulls") == 0).alias("is_clean"))


def nonzero_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-zero count per derived feature."""
    one = df.agg(*[F.count_if(F.col(c) != 0).alias(c) for c in cols])
    return one.unpivot([], cols, "feature", "non_zero")


def group_families(names: list[str], family_of) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c in names:
        f = family_of(c)
        if f is not None:
            out.setdefault(f, []).append(c)
    return out


def feature_families(df: DataFrame, family_of) -> DataFrame:
    """Per name family, the number of features and of non-zero values
    they hold (one counting pass over the table)."""
    fams = group_families(df.columns, family_of)
    if not fams:
        return df.sparkSession.createDataFrame([], "family string, n_features int, non_zero_values long")
    one = df.agg(*[F.count_if(F.col(c) != 0).alias(c) for cs in fams.values() for c in cs])
    parts = []
    for fam, cs in sorted(fams.items()):
        total = None
        for c in cs:
            total = F.col(c) if total is None else total + F.col(c)
        parts.append(F.struct(F.lit(fam).alias("family"), F.lit(len(cs)).alias("n_features"),
                              total.alias("non_zero_values")))
    return one.select(F.explode(F.array(*parts)).alias("f")).select("f.*")
