"""Scenario scoring and the macro bootstrap.

Firms x scenarios are generated map-side with ``explode`` over the 7 literal
scenarios, firms x draws with ``explode`` over the draw numbers and a
size-checked broadcast of the draw table; the only shuffles are the final
group-bys, which pre-aggregate map-side.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import percentiles
from ..session import dealt
from .registry import Macro, shocked_forms

# Scenario shifts on (inflation, interest rate, gdp growth).
SCENARIOS = [
    ("BASE", "Base Case", 0.0, 0.0, 0.0),
    ("INFLATION_SHOCK", "Inflation Shock", 8.0, 2.0, -1.5),
    ("RATE_HIKE", "Aggressive Rate Hikes", 2.0, 5.0, -2.0),
    ("RECESSION", "Severe Recession", -2.0, -3.0, -5.0),
    ("RECOVERY", "Strong Recovery", 1.0, 1.0, 3.0),
    ("STAGFLATION", "Stagflation", 10.0, 4.0, -3.0),
    ("SOFT_LANDING", "Soft Landing", -2.0, -1.0, -0.5),
]
IMPACT_SCENARIOS = ["INFLATION_SHOCK", "RATE_HIKE", "RECESSION", "STAGFLATION", "SOFT_LANDING"]
# Baseline macro defaults used only when a column is absent.
DEFAULT_BASELINE = {"inflation": 3.0, "fed_rate": 4.5, "gdp_growth": 2.5}

# The build's linear scorer (SQL-checkable stand-in for a model).
LINEAR_SCORER = {
    "roa": (0.02, [("debt_ratio", -0.05), ("inflation_debt_interaction", -0.002),
                   ("rate_debt_interaction", -0.003), ("gdp_efficiency_interaction", 0.004),
                   ("rate_liquidity_interaction", -0.001), ("inflation_squeeze", -0.0005),
                   ("liquidity_crisis", -0.002), ("stress_intensity", -0.0004),
                   ("pricing_power", 0.01), ("margin_rate_interaction", 0.01),
                   ("roa_lag1", 0.5)]),
    "profit_margin": (0.05, [("gross_margin", 0.3), ("inflation_margin_interaction", -0.001),
                             ("turnover_inflation_interaction", -0.004), ("size_gdp_interaction", 0.001),
                             ("liquidity_gdp_interaction", 0.002), ("rollover_risk", -0.01),
                             ("volatility_debt_interaction", -0.1), ("stress_intensity", -0.0008),
                             ("profit_margin_lag1", 0.4)]),
}
# Bootstrap noise standard deviations per macro variable.
NOISE_SD = {"inflation": 0.5, "fed_rate": 0.3, "gdp_growth": 0.5}
BROADCAST_DRAWS = 1_000_000     # rows of a draw table broadcast at most (32 bytes each)
HASH_DIGITS = 15                # hex digits of a draw's hash: 60 bits
SCORED_ROWS = 200_000           # rows that a task scores at most, about
DRAWS_AT_ONCE = 10_000          # draws that a firm's row is exploded to in one task at most


def linear_score(target: str, scorer=LINEAR_SCORER) -> Column:
    """intercept + sum(weight * feature), evaluated left to right; a missing
    feature value counts as 0 (C11)."""
    b, terms = scorer[target]
    e = F.lit(float(b))
    for f, w in terms:
        e = e + F.lit(float(w)) * F.coalesce(F.col(f), F.lit(0.0))
    return e


def linear_scorer(scorer=LINEAR_SCORER) -> Callable[[DataFrame, list[str]], DataFrame]:
    """A scorer adds a column ``predicted_<target>`` for each target; this one
    does so with linear terms, ``boosting.arrow_scorer`` with trained trees."""
    return lambda df, targets: df.withColumns({f"predicted_{t}": linear_score(t, scorer) for t in targets})


def _by_target(scored: DataFrame, targets: list[str], keep: list) -> DataFrame:
    """One row per target from the columns a scorer added."""
    parts = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"predicted_{t}").alias("predicted")) for t in targets])
    return scored.select(*keep, F.explode(parts).alias("p")).select("*", "p.*").drop("p")


def latest_per_company(df: DataFrame, cols: list[str], key: str = "company",
                       time_col: str = "year") -> DataFrame:
    """Pandas ``groupby.last()``: per column, the value of the latest
    period where that column is non-null (not simply the latest row)."""
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(time_col))).alias(c)
            for c in cols if c not in (key,)]
    return df.groupBy(key).agg(*aggs)


def baseline_macros(df: DataFrame, time_col: str = "year") -> dict:
    """Macros of the first row (smallest company) of the latest period.
    Returns three scalars (a bounded, one-row aggregate)."""
    cols = [c for c in DEFAULT_BASELINE if c in df.columns]
    latest = df.agg(F.max(time_col)).first()[0]
    row = (df.where(F.col(time_col) == latest)
             .agg(F.min_by(F.struct(*cols), F.col("company")).alias("b")).first()["b"])
    out = dict(DEFAULT_BASELINE)
    for c in cols:
        out[c] = float(row[c]) if row is not None and row[c] is not None else out[c]
    return out


def scenario_values(base: dict) -> list[tuple]:
    """(scenario, name, inflation, interest, gdp) = baseline + shift."""
    return [(k, n, base["inflation"] + di, base["fed_rate"] + dr, base["gdp_growth"] + dg)
            for k, n, di, dr, dg in SCENARIOS]


def scenario_table(spark, base: dict) -> DataFrame:
    return spark.createDataFrame(scenario_values(base),
                                 "scenario string, name string, s_inflation double, "
                                 "s_interest double, s_gdp double")


def update_macro_terms(df: DataFrame, infl: Column, rate: Column, gdp: Column,
                       mode: str = "reference") -> DataFrame:
    """The panel's macro columns replaced, and the registry's
    macro-dependent columns evaluated on the new values.  ``reference`` leaves
    the recession flag, perfect storm, default triple, distress signal and
    cash-rate terms stale, as the analysed pipeline does; ``full`` does not."""
    given = {"inflation": infl, "fed_rate": rate, "gdp_growth": gdp, "gdp": gdp}
    macros = {n: v for n, v in given.items() if n in df.columns}
    return df.withColumns(macros | shocked_forms(df.columns, Macro(infl, rate, gdp), mode))


def firms_by_scenario(latest: DataFrame, base: dict, mode: str = "reference") -> DataFrame:
    """G6 + J3: every firm's latest row once per scenario, macro terms
    recomputed.  Generated with ``explode`` over the 7 literal scenarios."""
    arr = F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(i).alias("s_inflation"),
                             F.lit(r).alias("s_interest"), F.lit(g).alias("s_gdp"))
                    for k, _n, i, r, g in scenario_values(base)])
    x = latest.withColumn("__s", F.explode(arr))
    x = x.withColumns({"scenario": F.col("__s.scenario")})
    x = update_macro_terms(x, F.col("__s.s_inflation"), F.col("__s.s_interest"),
                           F.col("__s.s_gdp"), mode)
    return x.drop("__s")


def score_scenarios(latest: DataFrame, base: dict, targets: list[str],
                    scorer=linear_scorer(), mode: str = "reference") -> DataFrame:
    """J4 with any scorer: (target, scenario, company, sector, predicted,
    debt_ratio, current_ratio)."""
    latest = dealt(latest, latest.count(), SCORED_ROWS // len(SCENARIOS))
    x = scorer(firms_by_scenario(latest, base, mode), targets)
    sector = F.coalesce(F.col("sector"), F.lit("Unknown")).alias("sector")
    return _by_target(x, targets, ["scenario", "company", sector, "debt_ratio", "current_ratio"]).select(
        "target", "scenario", "company", "sector", "predicted", "debt_ratio", "current_ratio")


def base_vs_scenarios(pred: DataFrame, scenarios=None) -> DataFrame:
    """Per (target, company) the BASE prediction beside each scenario's
    prediction, by one pre-aggregating group-by (no self-join)."""
    names = scenarios or [s[0] for s in SCENARIOS]
    return pred.groupBy("target", "company").agg(
        F.first("sector").alias("sector"),
        F.first("debt_ratio").alias("debt_ratio"), F.first("current_ratio").alias("current_ratio"),
        *[F.max(F.when(F.col("scenario") == s, F.col("predicted"))).alias(s.lower()) for s in names])


def stress_impacts(wide: DataFrame) -> DataFrame:
    """Mean over firms of (s - b) / max(|b|, .001) * 100 per scenario."""
    b = F.col("base")
    rows = [F.struct(F.lit(s).alias("scenario"),
                     ((F.col(s.lower()) - b) / F.greatest(F.abs(b), F.lit(0.001)) * 100).alias("impact"))
            for s in IMPACT_SCENARIOS]
    long = wide.select("target", F.explode(F.array(*rows)).alias("r")).select("target", "r.*")
    names = {k: n for k, n, *_ in SCENARIOS}
    name_expr = None
    for k in IMPACT_SCENARIOS:
        cond = F.col("scenario") == k
        name_expr = F.when(cond, F.lit(names[k])) if name_expr is None else name_expr.when(cond, F.lit(names[k]))
    return long.groupBy("target", "scenario").agg(F.avg("impact").alias("impact_pct")).select(
        "target", "scenario", name_expr.alias("scenario_name"), "impact_pct",
        F.when(F.col("impact_pct") > 0, "UP").otherwise("DOWN").alias("direction"))


# ------------------------------------------------------------ bootstrap --

def _hash(*parts) -> Column:
    """An integer below 2^60 from the md5 of the parts."""
    key = F.concat_ws(":", *[F.lit(p) if isinstance(p, (int, str)) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, HASH_DIGITS), 16, 10).cast("long")


def draw_table(panel: DataFrame, n_sims: int = 500, time_col: str = "year",
               seed: int = 42) -> DataFrame:
    """J8 draws: for each sim and macro variable, a period picked with
    probability proportional to its panel rows (as picking a random panel
    row), plus normal noise.  Pick and noise are independent hashes of (seed,
    sim, variable, stream), so the table does not depend on partitioning.

    The period table has one row per period; it reaches the draws as a scalar
    subquery (an array sorted by period), with no join and no trip to the
    driver program.  An empty panel gives NULL macros."""
    variables = list(NOISE_SD)
    earlier = Window.orderBy(time_col).rowsBetween(Window.unboundedPreceding, -1)   # one row per period
    # where the rows of a period disagree: the values most rows hold, as in the period table
    each = panel.groupBy(time_col, *variables).agg(F.count(F.lit(1)).alias("n"))
    known = sum((F.col(v).isNull().cast("int") for v in variables), F.lit(0))
    order = F.struct(known.alias("unknown"), (-F.col("n")).alias("n"), *variables)
    periods = each.groupBy(time_col).agg(F.sum("n").alias("n_rows"), F.min_by(F.struct(*variables), order).alias("m"))
    periods = periods.select(time_col, "n_rows", *[F.col("m")[v].cast("double").alias(v) for v in variables])
    periods = periods.withColumn("start", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)))
    table = periods.agg(
        F.array_sort(F.collect_list(F.struct("start", *variables))).alias("periods"),
        F.sum("n_rows").alias("total"))
    sims = panel.sparkSession.range(n_sims).select(
        F.col("id").alias("sim_id"), table.select(F.struct("periods", "total")).scalar().alias("t"))
    unit = float(16 ** HASH_DIGITS)
    drawn = {}
    for v in variables:
        pick, u1, u2 = (_hash(seed, F.col("sim_id"), v, stream) for stream in ("pick", "radius", "angle"))
        row = pick % F.col("t.total")
        period = F.try_element_at(F.filter("t.periods", lambda p: p["start"] <= row), F.lit(-1))
        z = (F.sqrt(-2.0 * F.log((u1 + 1).cast("double") / unit))
             * F.cos(2 * math.pi * (u2.cast("double") / unit)))
        drawn[v] = period[v] + z * NOISE_SD[v]
    return sims.withColumns(drawn).select("sim_id", *variables)


def bootstrap_means(latest: DataFrame, draws: DataFrame, targets: list[str],
                    scorer=linear_scorer()) -> DataFrame:
    """J8 with any scorer: every firm under every draw; mean prediction per draw.
    Draws are numbered from 0, so each firm row is exploded over the numbers
    and joined with the draw table by number: broadcast up to a checked
    number of draws, shuffled on the (evenly spread) number beyond it.  Firms
    are few bytes but many scored rows, so they are dealt to tasks by the
    number of rows that they become."""
    n = draws.count()
    if n == 0:
        return draws.select(F.lit(None).cast("string").alias("target"), "sim_id",
                            F.lit(None).cast("double").alias("mean_prediction")).limit(0)
    numbered = draws.select("sim_id", *[F.col(v).alias(f"__{v}") for v in NOISE_SD])
    if n <= BROADCAST_DRAWS:
        numbered = F.broadcast(numbered)
    step = min(n, DRAWS_AT_ONCE)
    x = latest.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"), F.lit(step).cast("long"))))
    x = dealt(x, latest.count() * -(-n // step), max(1, SCORED_ROWS // step))
    x = x.withColumn("sim_id", F.explode(F.sequence("__from", F.least(F.col("__from") + (step - 1), F.lit(n - 1)))))
    x = x.drop("__from").join(numbered, "sim_id")
    x = update_macro_terms(x, *[F.col(f"__{v}") for v in NOISE_SD])
    return (_by_target(scorer(x, targets), targets, ["sim_id"]).groupBy("target", "sim_id")
            .agg(F.avg("predicted").alias("mean_prediction")).select("target", "sim_id", "mean_prediction"))


def bootstrap_summary(means: DataFrame) -> DataFrame:
    """Mean, population std, 90% and 95% bounds, interval widths."""
    q = percentiles(F.col("mean_prediction"), [0.05, 0.95, 0.025, 0.975])
    a = means.groupBy("target").agg(F.avg("mean_prediction").alias("mean"),
                                    F.stddev_pop("mean_prediction").alias("std"),
                                    q.alias("q"), F.count(F.lit(1)).alias("n_sims"))
    return a.select("target", "n_sims", "mean", "std",
                    F.col("q")[0].alias("ci_90_lower"), F.col("q")[1].alias("ci_90_upper"),
                    F.col("q")[2].alias("ci_95_lower"), F.col("q")[3].alias("ci_95_upper"),
                    (F.col("q")[3] - F.col("q")[2]).alias("ci_95_width"))


def histogram(means: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width histogram per target, last edge inclusive; bins without
    draws have count 0."""
    edges = means.groupBy("target").agg(F.min("mean_prediction").alias("lo"), F.max("mean_prediction").alias("hi"))
    x = means.join(edges, "target")
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("mean_prediction") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1,
                F.lit(bins)))
    counts = x.withColumn("bin", b.cast("int")).groupBy("target", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return every.join(counts, ["target", "bin"], "left").select(
        "target", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "lo", "hi")
