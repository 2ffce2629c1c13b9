"""DuckDB twins of the panel layers, as CTE text.

These are independent SQL formulations of the same semantics (window
functions, ``median`` over partitions, ``NULLIF`` denominators) used only by
``oracle_sql()`` to check the Spark operators.  ``with_layers(upto, body)``
prefixes a query body with the CTE chain up to a layer:

raw -> clean -> l1 -> l2
"""

from __future__ import annotations

from ..operators import clean as C
from ..operators import features as FE
from ..sources.fixtures import PANEL_A_MEASURES, PANEL_A_SQL, duckdb_sql

W = "PARTITION BY company ORDER BY year"


def d(x) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def sdiv(a: str, b: str) -> str:
    return f"(({a}) / NULLIF(({b}), 0))"


def sclip(x: str, lo=None, hi=None) -> str:
    e = x
    if lo is not None:
        e = f"greatest({e}, {d(lo)})"
    if hi is not None:
        e = f"least({e}, {d(hi)})"
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE {e} END)"


def sflag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


RAW_COLS = ["company", "year", "sector"] + list(PANEL_A_MEASURES)


def _sel(cols, override: dict) -> str:
    return ",\n  ".join(f"{override[c]} AS {c}" if c in override else c for c in cols)


def clean_ctes() -> list[tuple[str, str]]:
    cols = RAW_COLS
    interp = [c for c in list(C.MODERATE_COLUMNS) + C.INTERPOLATE_COLUMNS if c in cols]
    moderate = [c for c in C.MODERATE_COLUMNS if c in cols]
    ctes = [("raw", duckdb_sql(PANEL_A_SQL)),
            ("c_pos", f"SELECT *, row_number() OVER ({W}) AS __pos FROM raw")]
    parts = []
    back = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    fwd = f"OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    for c in interp:
        pnn = f"CASE WHEN {c} IS NOT NULL THEN __pos END"
        parts += [f"last_value({c} IGNORE NULLS) {back} AS __pv_{c}",
                  f"last_value({pnn} IGNORE NULLS) {back} AS __pp_{c}",
                  f"first_value({c} IGNORE NULLS) {fwd} AS __nv_{c}",
                  f"first_value({pnn} IGNORE NULLS) {fwd} AS __np_{c}"]
    ctes.append(("c_nb", "SELECT *, " + ", ".join(parts) + " FROM c_pos"))
    ov = {}
    for c in interp:
        pv, pp, nv, np_ = f"__pv_{c}", f"__pp_{c}", f"__nv_{c}", f"__np_{c}"
        ov[c] = (f"CASE WHEN {c} IS NOT NULL THEN {c} "
                 f"WHEN {pv} IS NOT NULL AND {nv} IS NOT NULL THEN "
                 f"{pv} + ({nv} - {pv}) / CAST({np_} - {pp} AS DOUBLE) * CAST(__pos - {pp} AS DOUBLE) "
                 f"ELSE coalesce({pv}, {nv}) END")
    ctes.append(("c_interp", f"SELECT {_sel(cols, ov)} FROM c_nb"))
    ov = {c: f"coalesce({c}, median({c}) OVER (PARTITION BY sector, year))" for c in moderate}
    ctes.append(("c_sy", f"SELECT {_sel(cols, ov)} FROM c_interp"))
    ov = {c: f"coalesce({c}, cash * {d(C.MODERATE_COLUMNS[c])})" for c in moderate}
    ctes.append(("c_rel", f"SELECT {_sel(cols, ov)} FROM c_sy"))
    num = [c for c in cols if c not in ("company", "year", "sector")]
    ov = {c: f"coalesce({c}, median({c}) OVER (PARTITION BY company))" for c in num}
    ctes.append(("c_comp", f"SELECT {_sel(cols, ov)} FROM c_rel"))
    ov = {c: f"coalesce({c}, median({c}) OVER ())" for c in num}
    ctes.append(("clean", f"SELECT {_sel(cols, ov)} FROM c_comp"))
    return ctes


def l1_ctes() -> list[tuple[str, str]]:
    base = list(RAW_COLS)
    ratios = {
        "roa": sdiv("net_income", "total_assets"), "roe": sdiv("net_income", "equity"),
        "profit_margin": sdiv("net_income", "net_sales"),
        "gross_margin": sdiv("gross_profit", "net_sales"),
        "operating_margin": sdiv("operating_income", "net_sales"),
        "debt_ratio": sdiv("total_liabilities", "total_assets"),
        "debt_to_equity": sdiv("total_liabilities", "equity"),
        "equity_ratio": sdiv("equity", "total_assets"),
        "current_ratio": sdiv("current_assets", "current_liabilities"),
        "quick_ratio": sdiv("current_assets - inventories", "current_liabilities"),
        "asset_turnover": sdiv("net_sales", "total_assets"),
        "cfo_to_assets": sdiv("cfo", "total_assets"), "cfo_to_sales": sdiv("cfo", "net_sales"),
        "capex_to_sales": sdiv("abs(capex)", "net_sales"),
        "firm_size": f"ln({sclip('total_assets', lo=1.0)})",
        "stock_return_company": f"({sdiv('stock_price', f'lag(stock_price, 1) OVER ({W})')} - 1) * 100",
        "stock_return_sector": "sector_benchmark", "gdp_growth": "gdp",
    }
    ctes = [("f_ratio", "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in ratios.items())
             + " FROM clean")]
    cols1 = base + list(ratios)
    rc = FE.RATIO_COLUMNS
    ctes.append(("f_rc", f"SELECT {_sel(cols1, {c: f'coalesce({c}, median({c}) OVER (PARTITION BY company))' for c in rc})} FROM f_ratio"))
    ctes.append(("f_rs", f"SELECT {_sel(cols1, {c: f'coalesce({c}, median({c}) OVER (PARTITION BY sector, year))' for c in rc})} FROM f_rc"))
    ctes.append(("f_rg", f"SELECT {_sel(cols1, {c: f'coalesce({c}, median({c}) OVER ())' for c in rc})} FROM f_rs"))
    hist = {}
    for v in FE.LAG_VARIABLES:
        hist[f"{v}_lag1"] = f"coalesce(lag({v}, 1) OVER ({W}), {d(0.0)})"
        hist[f"{v}_lag2"] = f"coalesce(lag({v}, 2) OVER ({W}), {d(0.0)})"
    for v in FE.ROLLING_VARIABLES:
        hist[f"{v}_rolling3"] = f"avg({v}) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    w5 = f"OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    hist["roa_volatility"] = f"CASE WHEN count(roa) {w5} >= 3 THEN stddev_samp(roa) {w5} END"
    ctes.append(("f_hist", "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in hist.items())
                 + " FROM f_rg"))
    trends = {f"{v}_trend": f"({v} - {v}_lag1) / (abs({v}_lag1) + {d(1e-6)})"
              for v in FE.ROLLING_VARIABLES}
    inter = {
        "inflation_debt_interaction": "inflation * debt_ratio",
        "rate_debt_interaction": "fed_rate * debt_ratio",
        "gdp_efficiency_interaction": "gdp_growth * asset_turnover",
        "market_fundamental_interaction": "stock_return_company * roa",
        "rate_liquidity_interaction": f"fed_rate * {sdiv(d(1.0), sclip('current_ratio', lo=0.1))}",
        "inflation_margin_interaction": f"inflation * {sdiv(d(1.0), sclip('gross_margin', lo=0.01))}",
        "gdp_leverage_interaction": "gdp_growth * debt_to_equity",
        "volatility_debt_interaction": "roa_volatility * debt_ratio",
        "size_gdp_interaction": "firm_size * gdp_growth",
        "margin_rate_interaction": "profit_margin * fed_rate",
        "turnover_inflation_interaction": "asset_turnover * inflation",
        "cash_ratio": sdiv("cash", "current_liabilities"),
        "size_volatility_interaction": "firm_size * roa_volatility",
        "liquidity_gdp_interaction": "quick_ratio * gdp_growth",
    }
    ctes.append(("f_int", "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in {**trends, **inter}.items())
                 + " FROM f_hist"))
    ctes.append(("f_int2", "SELECT *, cash_ratio * fed_rate AS cash_rate_interaction FROM f_int"))
    cols = base + FE.layer1_new_columns()
    fam = [c for c in cols if "interaction" in c or "volatility" in c]
    ctes.append(("f_ic", f"SELECT {_sel(cols, {c: f'coalesce({c}, median({c}) OVER (PARTITION BY company))' for c in fam})} FROM f_int2"))
    ctes.append(("l1", f"SELECT {_sel(cols, {c: f'coalesce({c}, median({c}) OVER (), {d(0.0)})' for c in fam})} FROM f_ic"))
    return ctes


def l2_ctes() -> list[tuple[str, str]]:
    ctes = [("g_rec", f"SELECT *, {sflag('gdp_growth < 0')} AS recession FROM l1")]
    tw = {
        "perfect_storm_risk": "inflation * debt_ratio * fed_rate",
        "default_risk_triple": "debt_ratio * fed_rate * recession",
        "inflation_squeeze": f"inflation * {sdiv(d(1.0), f'abs(profit_margin) + {d(0.01)}')} * debt_ratio",
        "liquidity_crisis": f"abs({sclip('gdp_growth', hi=0.0)}) * debt_to_equity * {sdiv(d(1.0), f'current_ratio + {d(0.01)}')}",
        "rollover_risk": "roa_volatility * debt_ratio * fed_rate",
        "pricing_power": "inflation * asset_turnover * profit_margin",
        "distress_signal": f"abs({sclip('stock_return_company', hi=0.0)}) * debt_ratio * recession",
    }
    bands = band_sql()
    bands["fed_rate_change"] = f"fed_rate - lag(fed_rate, 1) OVER ({W})"
    ctes.append(("g_tw", "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in {**tw, **bands}.items())
                 + " FROM g_rec"))
    pol = {
        "regime_easing": sflag("fed_rate_change < -0.25"),
        "regime_neutral": sflag("fed_rate_change >= -0.25 AND fed_rate_change <= 0.25"),
        "regime_tightening": sflag("fed_rate_change > 0.25"),
        "stagflation": sflag("regime_high_inflation = 1 AND (regime_mild_recession = 1 OR regime_severe_recession = 1)"),
        "regime_code": ("(regime_deflation * 1000 + regime_low_inflation * 100 + regime_moderate_inflation * 10"
                        " + regime_high_inflation) * 10 + (regime_severe_recession * 1000"
                        " + regime_mild_recession * 100 + regime_slow_growth * 10 + regime_strong_growth)"),
    }
    ctes.append(("g_pol", "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in pol.items())
                 + " FROM g_tw"))
    st = stress_sql()
    ctes.append(("g_st", "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in st.items())
                 + " FROM g_pol"))
    ctes.append(("g_si", "SELECT *, (" + " + ".join(f"coalesce({p}, {d(0.0)})" for p in FE.STRESS_PARTS)
                 + ") * 100 AS stress_intensity FROM g_st"))
    cols = RAW_COLS + FE.layer1_new_columns() + FE.layer2_new_columns()
    num = [c for c in cols if c not in ("company", "sector")]
    ctes.append(("l2", f"SELECT {_sel(cols, {c: f'coalesce({c}, 0)' for c in num})} FROM g_si"))
    return ctes


def band_sql(infl="inflation", rate="fed_rate", gdp="gdp_growth") -> dict:
    i, r, g = infl, rate, gdp
    return {
        "regime_deflation": sflag(f"{i} < 0"),
        "regime_low_inflation": sflag(f"{i} >= 0 AND {i} <= 2"),
        "regime_moderate_inflation": sflag(f"{i} > 2 AND {i} <= 5"),
        "regime_high_inflation": sflag(f"{i} > 5"),
        "regime_emergency_rates": sflag(f"{r} >= 0 AND {r} <= 1"),
        "regime_low_rates": sflag(f"{r} > 1 AND {r} <= 3"),
        "regime_moderate_rates": sflag(f"{r} > 3 AND {r} <= 5"),
        "regime_high_rates": sflag(f"{r} > 5"),
        "regime_severe_recession": sflag(f"{g} < -2"),
        "regime_mild_recession": sflag(f"{g} >= -2 AND {g} < 0"),
        "regime_slow_growth": sflag(f"{g} >= 0 AND {g} < 2"),
        "regime_strong_growth": sflag(f"{g} >= 2"),
    }


def stress_sql(infl="inflation", rate="fed_rate", gdp="gdp_growth") -> dict:
    return {
        "inflation_stress": sclip(f"{infl} / 10", 0.0, 0.25),
        "rate_stress": sclip(f"{rate} / 8", 0.0, 0.25),
        "gdp_stress": sclip(f"{sclip(f'-{gdp}', 0.0, 5.0)} / 20", 0.0, 0.25),
        "recession_stress": f"CAST(recession AS DOUBLE) * {d(0.25)}",
    }


_LAYERS = {"raw": lambda: [("raw", duckdb_sql(PANEL_A_SQL))],
           "clean": clean_ctes,
           "l1": lambda: clean_ctes() + l1_ctes(),
           "l2": lambda: clean_ctes() + l1_ctes() + l2_ctes()}


def layer_ctes(upto: str) -> list[tuple[str, str]]:
    return _LAYERS[upto]()


def with_layers(upto: str, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    ctes = _LAYERS[upto]() + (extra or [])
    return "WITH " + ",\n".join(f"{n} AS (\n{q}\n)" for n, q in ctes) + "\n" + body


# ------------------------------------------------------ scenario twins --

def latest_sql(cols: list[str], src: str = "l2") -> str:
    """E4 twin: per company, each column's value at its latest non-null year."""
    return ("SELECT company, " + ", ".join(
        f"arg_max({c}, CASE WHEN {c} IS NOT NULL THEN year END) AS {c}" for c in cols)
        + f" FROM {src} GROUP BY company")


def update_terms_sql(i: str, r: str, g: str) -> dict:
    """J3 twin (reference mode) over scenario columns i, r, g."""
    return {
        "inflation": i, "fed_rate": r, "gdp_growth": g, "gdp": g,
        "inflation_debt_interaction": f"{i} * debt_ratio",
        "rate_debt_interaction": f"{r} * debt_ratio",
        "gdp_leverage_interaction": f"{g} * debt_to_equity",
        "rate_liquidity_interaction": f"{r} * {sdiv(d(1.0), sclip('current_ratio', lo=0.1))}",
        "inflation_margin_interaction": f"{i} * {sdiv(d(1.0), sclip('gross_margin', lo=0.01))}",
        "gdp_efficiency_interaction": f"{g} * asset_turnover",
        "turnover_inflation_interaction": f"{i} * asset_turnover",
        "margin_rate_interaction": f"profit_margin * {r}",
        "size_gdp_interaction": f"firm_size * {g}",
        "liquidity_gdp_interaction": f"quick_ratio * {g}",
        "volatility_debt_interaction": "roa_volatility * debt_ratio",
        "rollover_risk": f"roa_volatility * debt_ratio * {r}",
        "inflation_squeeze": f"{i} * {sdiv(d(1.0), sclip('abs(profit_margin)', lo=0.01))} * debt_ratio",
        "liquidity_crisis": f"greatest({d(0.0)}, -{g}) * debt_to_equity * {sdiv(d(1.0), sclip('current_ratio', lo=0.01))}",
        "pricing_power": f"{i} * asset_turnover * profit_margin",
        "stress_intensity": (f"(least({d(0.25)}, greatest({d(0.0)}, {i}) / 10) + "
                             f"least({d(0.25)}, greatest({d(0.0)}, {r}) / 8) + "
                             f"least({d(0.25)}, greatest({d(0.0)}, -{g}) / 20)) * 100"),
    }


def score_sql(target: str, scorer) -> str:
    b, terms = scorer[target]
    e = d(float(b))
    for f, w in terms:
        e = f"({e} + {d(float(w))} * coalesce({f}, {d(0.0)}))"
    return e
