"""Risk tables.

Per-firm work is expressions over the (target, company) wide table built by
one pre-aggregating group-by; per-sector and per-scenario tables are small
aggregates.  The global risk ranking uses a range-partitioned sort plus
per-partition offsets instead of a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def risk_level(score) -> "F.Column":
    """>=60 CRITICAL, >=40 HIGH, >=25 MEDIUM, else LOW."""
    return (F.when(score >= 60, "CRITICAL").when(score >= 40, "HIGH")
             .when(score >= 25, "MEDIUM").otherwise("LOW"))


def screen_level(score) -> "F.Column":
    """>60 HIGH, >35 MED, else LOW (strict bounds)."""
    return F.when(score > 60, "HIGH").when(score > 35, "MED").otherwise("LOW")


def sector_flag(avg) -> "F.Column":
    """>=40 '!', >=25 '?', else '.'."""
    return F.when(avg >= 40, "!").when(avg >= 25, "?").otherwise(".")


def sector_band(avg) -> "F.Column":
    """Chart bands of the sector comparison: >=40, >=25, >=15, below."""
    return F.when(avg >= 40, "darkred").when(avg >= 25, "red").when(avg >= 15, "orange").otherwise("green")


def mean_of_scores(score) -> "F.Column":
    """Mean of scores of two digits, summed as decimals: a tie of the rounding
    does not depend on the order of rows."""
    return F.sum(score.cast("decimal(12,2)")).cast("double") / F.count(score)


def roa_history(panel: DataFrame, key: str = "company") -> DataFrame:
    """Population std of each company's roa history and its length."""
    return panel.groupBy(key).agg(F.stddev_pop("roa").alias("roa_std"),
                                  F.count("roa").alias("roa_n"))


def risk_scores(wide: DataFrame, history: DataFrame) -> DataFrame:
    """0-100 score = .4 vulnerability + .3 leverage + .2 volatility + .1
    liquidity, per (target, company), rounded like the reference."""
    b, s = F.col("base"), F.col("stagflation")
    vuln = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(
        F.abs(b) > 0.001, (b - s) / F.abs(b) * 100).otherwise(F.lit(50.0))))
    lev = F.least(F.lit(100.0), F.coalesce(F.col("debt_ratio"), F.lit(0.5)) * 100)
    vol = F.when(F.col("roa_n") > 1, F.least(F.lit(100.0), F.col("roa_std") * 100 * 2)).otherwise(F.lit(20.0))
    liq = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.try_divide(
        F.lit(1.0), F.coalesce(F.col("current_ratio"), F.lit(1.0)) + 0.01) * 50))
    x = wide.join(history, "company", "left").select(
        "company", "sector", F.upper("target").alias("target"), b.alias("baseline"),
        s.alias("stagflation_pred"), vuln.alias("v"), lev.alias("l"), vol.alias("o"), liq.alias("q"))
    score = 0.40 * F.col("v") + 0.30 * F.col("l") + 0.20 * F.col("o") + 0.10 * F.col("q")
    return x.select("company", "sector", "target",
                    F.bround(score, 2).alias("risk_score"),
                    F.bround("v", 2).alias("stress_vulnerability"), F.bround("l", 2).alias("leverage_risk"),
                    F.bround("o", 2).alias("volatility_risk"), F.bround("q", 2).alias("liquidity_risk"),
                    F.bround("baseline", 4).alias("baseline"),
                    F.bround("stagflation_pred", 4).alias("stagflation"))


def primary_extremes(risk: DataFrame, k: int = 10) -> DataFrame:
    """ROA rows (one per company): top-k and bottom-k by score with a
    company tie-break, screen level attached (two bounded top-k sorts)."""
    roa = risk.where(F.col("target") == "ROA").dropDuplicates(["company"])
    top = roa.orderBy(F.desc("risk_score"), "company").limit(k).withColumn("side", F.lit("top"))
    bot = roa.orderBy(F.asc("risk_score"), "company").limit(k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bot).select("side", "company", "sector", "risk_score",
                                       screen_level(F.col("risk_score")).alias("screen_level"))


def warnings(wide: DataFrame) -> DataFrame:
    """Stagflation drop > 30%, debt ratio > .7, current ratio < 1; rows
    without any warning dropped."""
    b, s = F.col("base"), F.col("stagflation")
    drop = F.when(F.abs(b) > 0.001, (b - s) / F.abs(b) * 100).otherwise(F.lit(0.0))
    dr = F.coalesce(F.col("debt_ratio"), F.lit(0.0))
    cr = F.coalesce(F.col("current_ratio"), F.lit(1.0))
    x = wide.select("company", "sector", F.upper("target").alias("target"), drop.alias("drop"),
                    dr.alias("dr"), cr.alias("cr"))
    w = F.array_compact(F.array(
        F.when(F.col("drop") > 30, F.format_string("CRITICAL: %.0f%% drop under stagflation", F.col("drop"))),
        F.when(F.col("dr") > 0.7, F.concat(F.lit("HIGH LEVERAGE: "),
                                           F.format_string("%.1f%%", F.col("dr") * 100))),
        F.when(F.col("cr") < 1, F.format_string("LIQUIDITY CRISIS: Current ratio = %.2f", F.col("cr")))))
    x = x.withColumn("warning_list", w).where(F.size("warning_list") > 0)
    return x.select("company", "sector", "target",
                    F.concat_ws(" | ", "warning_list").alias("warnings"),
                    F.bround("drop", 1).alias("stress_drop_pct"), F.bround("dr", 3).alias("leverage"),
                    F.bround("cr", 2).alias("current_ratio"))


def by_drop(warn: DataFrame) -> DataFrame:
    """The warning rows, largest drop first."""
    return warn.orderBy(F.desc("stress_drop_pct"), "company", "target")


def sector_impact(pred: DataFrame, target: str = "ROA") -> DataFrame:
    """Stagflation vs base sector means of one target, % impact with floor
    .001, most negative first."""
    perf = sector_performance(pred).where(F.col("target") == target)
    s, b = (perf.where(F.col("scenario") == k).select("sector", F.col("mean_predicted").alias(f"predicted_{n}"))
            for k, n in (("STAGFLATION", "stress"), ("BASE", "base")))
    change = (F.col("predicted_stress") - F.col("predicted_base")) / F.greatest(F.abs(F.col("predicted_base")), F.lit(0.001)) * 100
    return s.join(b, "sector").withColumn("impact_pct", change).orderBy("impact_pct", "sector")


def warning_types(warn: DataFrame) -> DataFrame:
    """Counts of warning types with share of all type mentions."""
    t = warn.select(F.explode(F.array_compact(F.array(
        F.when(F.col("warnings").contains("HIGH LEVERAGE"), F.lit("High Leverage")),
        F.when(F.col("warnings").contains("LIQUIDITY CRISIS"), F.lit("Liquidity Crisis")),
        F.when(F.col("warnings").contains("CRITICAL"), F.lit("Critical Drop"))))).alias("warning_type"))
    g = t.groupBy("warning_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select("warning_type", "n",
                    (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("share_pct"))


def warnings_per_firm(warn: DataFrame, k: int = 10) -> DataFrame:
    """Firms with the most warning rows (top k, company tie-break)."""
    return (warn.groupBy("company").agg(F.count(F.lit(1)).alias("n_warnings"))
                .orderBy(F.desc("n_warnings"), "company").limit(k))


def global_rank(df: DataFrame, order_cols: list, rank_col: str = "rank") -> DataFrame:
    """F8: 1-based position in a total order without a single-partition
    window: range-partitioned sort, per-partition counts, offsets by a
    window over the (few) partitions.  The sorted, numbered frame is written
    as a reliable checkpoint so positions are stable under recomputation."""
    s = df.orderBy(*order_cols).withColumns({
        "__pid": F.spark_partition_id(), "__mid": F.monotonically_increasing_id()})
    s = cut_lineage(s)
    per = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__m0"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    out = s.join(F.broadcast(per), "__pid").withColumn(
        rank_col, (F.col("__off") + F.col("__mid") - F.col("__m0") + 1).cast("long"))
    return out.drop("__pid", "__mid", "__m0", "__n", "__off")


def risk_ranking(risk: DataFrame) -> DataFrame:
    """Risk table ranked by score (ties by company, target) with level."""
    r = global_rank(risk, [F.desc("risk_score"), F.asc("company"), F.asc("target")])
    return r.withColumn("risk_level", risk_level(F.col("risk_score")))


def sector_summary(risk: DataFrame) -> DataFrame:
    """Per sector avg/std/min/max/count of scores and flag.  The
    notebook's per-sector firm list is ``sector_firms`` (a long table): a
    sector may hold a large share of all firms, so it is never collected
    into one array."""
    g = risk.groupBy("sector").agg(
        F.bround(mean_of_scores(F.col("risk_score")), 2).alias("avg_risk"),
        F.bround(F.stddev_samp("risk_score"), 2).alias("std_risk"),
        F.bround(F.min("risk_score"), 2).alias("min_risk"),
        F.bround(F.max("risk_score"), 2).alias("max_risk"),
        F.count("risk_score").alias("firm_count"),
        F.count_distinct("company").alias("n_firms"))
    avg = F.col("avg_risk")
    return g.withColumns({"flag": sector_flag(avg), "band": sector_band(avg)}).orderBy(F.desc("avg_risk"), "sector")


def sector_firms(risk: DataFrame) -> DataFrame:
    """J13 (notebook): the firms of each sector, one row per (sector, firm)."""
    return risk.select("sector", "company").distinct()


def sector_primary_mean(risk: DataFrame) -> DataFrame:
    """Sector mean of the primary (ROA) risk score, chart band."""
    g = risk.where(F.col("target") == "ROA").groupBy("sector").agg(F.avg("risk_score").alias("avg_risk"))
    band = (F.when(F.col("avg_risk") > 60, "darkred").when(F.col("avg_risk") > 40, "red")
             .when(F.col("avg_risk") > 25, "orange").otherwise("green"))
    return g.withColumn("band", band)


def scenario_pivot(pred: DataFrame, targets: list[str]) -> DataFrame:
    """Mean prediction per scenario, one column per target,
    0 when a target is missing."""
    p = pred.groupBy("scenario").pivot("target", targets).agg(F.avg("predicted"))
    return p.na.fill(0.0, subset=targets)


def sector_performance(pred: DataFrame, scenarios=("BASE", "STAGFLATION", "RECESSION", "INFLATION_SHOCK")) -> DataFrame:
    """H8: mean prediction per (target, scenario, sector) for four scenarios."""
    return (pred.where(F.col("scenario").isin(*scenarios))
                .groupBy(F.upper("target").alias("target"), "scenario", "sector")
                .agg(F.avg("predicted").alias("mean_predicted")))


def kpi_row(risk: DataFrame, warn: DataFrame, drivers: DataFrame) -> DataFrame:
    """One-row dashboard: rows, distinct firms, counts over 40 and 60,
    leverage and liquidity warning counts, top firm, top sector (ties to the
    smallest name) with its label of 20 characters, top risk driver (I20).  The three inputs are tagged, unioned and reduced by
    one conditional aggregate (no join)."""
    sectors = risk.groupBy("sector").agg(F.avg("risk_score").alias("m"))
    u = (risk.select(F.lit("r").alias("t"), "company", "risk_score", F.lit(None).cast("string").alias("warnings"),
                     F.lit(None).cast("string").alias("sector"), F.lit(None).cast("double").alias("m"))
         .unionByName(warn.select(F.lit("w").alias("t"), F.lit(None).cast("string").alias("company"),
                                  F.lit(None).cast("double").alias("risk_score"), "warnings",
                                  F.lit(None).cast("string").alias("sector"), F.lit(None).cast("double").alias("m")))
         .unionByName(sectors.select(F.lit("s").alias("t"), F.lit(None).cast("string").alias("company"),
                                     F.lit(None).cast("double").alias("risk_score"),
                                     F.lit(None).cast("string").alias("warnings"), "sector", "m")))
    r, w, s = F.col("t") == "r", F.col("t") == "w", F.col("t") == "s"
    sc = F.col("risk_score")
    row = u.agg(
        F.count_if(r).alias("n_rows"),
        F.count_distinct(F.when(r, F.col("company"))).alias("n_firms"),
        F.count_if(r & (sc >= 40)).alias("n_high"),
        F.count_if(r & (sc >= 60)).alias("n_critical"),
        F.min_by(F.when(r, F.col("company")), F.when(r, F.struct((-sc).alias("s"), F.col("company")))).alias("top_firm"),
        F.bround(mean_of_scores(F.when(r, sc)), 2).alias("avg_risk"),
        F.count_if(w & F.col("warnings").contains("HIGH LEVERAGE")).alias("n_leverage_warnings"),
        F.count_if(w & F.col("warnings").contains("LIQUIDITY CRISIS")).alias("n_liquidity_warnings"),
        F.min_by(F.when(s, F.col("sector")), F.when(s, F.struct((-F.col("m")).alias("m"), F.col("sector"))))
         .alias("top_sector"))
    top = drivers.agg(F.min_by("feature", F.struct((-F.col("mean_negative")).alias("m"), F.col("feature")))).scalar()
    return row.withColumns({"top_sector_label": F.substring("top_sector", 1, 20), "top_driver": top})
