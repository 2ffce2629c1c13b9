"""Feature registry (C13): what every derived column is and is made of.

A ``Term`` is a column that crosses firm values with macro values.  Its form is
a function of the macro columns, so the layers evaluate it on the panel's
macros and a scenario or a draw evaluates it again on shifted ones.
``describe`` tells the family and the source variable of any derived column;
model features, imputation families and feature reports are queries on it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import clip, flag, safe_div

# Variables with history columns, and the base ratios.
RATIO_COLUMNS = ["roa", "roe", "profit_margin", "gross_margin", "operating_margin",
                 "debt_ratio", "debt_to_equity", "equity_ratio", "current_ratio",
                 "quick_ratio", "asset_turnover", "cfo_to_assets", "cfo_to_sales",
                 "capex_to_sales", "firm_size"]
LAG_VARIABLES = ["roa", "roe", "profit_margin", "debt_ratio", "current_ratio",
                 "asset_turnover", "firm_size"]
ROLLING_VARIABLES = ["roa", "roe", "profit_margin", "debt_ratio", "asset_turnover"]
LAGS = (1, 2)


@dataclass(frozen=True)
class Macro:
    """The macro columns that a term is evaluated on."""
    inflation: Column
    rate: Column
    growth: Column

    @property
    def recession(self) -> Column:
        return flag(self.growth < 0)


@dataclass(frozen=True)
class Term:
    """A firm x macro column.  ``needs`` are the panel columns it reads;
    ``shocked`` is its form under a scenario where that differs from the
    layer's; ``stale`` terms keep their panel value in scenario mode
    ``reference``; ``fixed`` ones read no macro and are never evaluated again."""
    name: str
    family: str
    needs: tuple[str, ...]
    form: Callable[[Macro], Column]
    shocked: Callable[[Macro], Column] | None = None
    stale: bool = False
    fixed: bool = False


def _over(column, floor: float) -> Column:
    return safe_div(F.lit(1.0), clip(column, lower=floor))


c = F.col
TERMS = [
    Term("inflation_debt_interaction", "interaction", ("debt_ratio",), lambda m: m.inflation * c("debt_ratio")),
    Term("rate_debt_interaction", "interaction", ("debt_ratio",), lambda m: m.rate * c("debt_ratio")),
    Term("gdp_efficiency_interaction", "interaction", ("asset_turnover",),
         lambda m: m.growth * c("asset_turnover")),
    Term("market_fundamental_interaction", "interaction", ("stock_return_company", "roa"),
         lambda m: c("stock_return_company") * c("roa"), fixed=True),
    Term("rate_liquidity_interaction", "interaction", ("current_ratio",),
         lambda m: m.rate * _over("current_ratio", 0.1)),
    Term("inflation_margin_interaction", "interaction", ("gross_margin",),
         lambda m: m.inflation * _over("gross_margin", 0.01)),
    Term("gdp_leverage_interaction", "interaction", ("debt_to_equity",),
         lambda m: m.growth * c("debt_to_equity")),
    # no macro, but evaluated again under a scenario from the filled columns
    Term("volatility_debt_interaction", "interaction", ("roa_volatility", "debt_ratio"),
         lambda m: c("roa_volatility") * c("debt_ratio")),
    Term("size_gdp_interaction", "interaction", ("firm_size",), lambda m: c("firm_size") * m.growth),
    Term("margin_rate_interaction", "interaction", ("profit_margin",), lambda m: c("profit_margin") * m.rate),
    Term("turnover_inflation_interaction", "interaction", ("asset_turnover",),
         lambda m: c("asset_turnover") * m.inflation),
    Term("cash_ratio", "ratio", ("cash", "current_liabilities"),
         lambda m: safe_div("cash", "current_liabilities"), fixed=True),
    Term("size_volatility_interaction", "interaction", ("firm_size", "roa_volatility"),
         lambda m: c("firm_size") * c("roa_volatility"), fixed=True),
    Term("liquidity_gdp_interaction", "interaction", ("quick_ratio",), lambda m: c("quick_ratio") * m.growth),
    Term("cash_rate_interaction", "interaction", ("cash_ratio",), lambda m: c("cash_ratio") * m.rate, stale=True),
    Term("perfect_storm_risk", "three_way", ("debt_ratio",),
         lambda m: m.inflation * c("debt_ratio") * m.rate, stale=True),
    Term("default_risk_triple", "three_way", ("debt_ratio",),
         lambda m: c("debt_ratio") * m.rate * m.recession, stale=True),
    Term("inflation_squeeze", "three_way", ("profit_margin", "debt_ratio"),
         lambda m: m.inflation * safe_div(F.lit(1.0), F.abs(c("profit_margin")) + 0.01) * c("debt_ratio"),
         shocked=lambda m: m.inflation * _over(F.abs(c("profit_margin")), 0.01) * c("debt_ratio")),
    Term("liquidity_crisis", "three_way", ("debt_to_equity", "current_ratio"),
         lambda m: F.abs(clip(m.growth, upper=0.0)) * c("debt_to_equity")
         * safe_div(F.lit(1.0), c("current_ratio") + 0.01),
         shocked=lambda m: F.greatest(F.lit(0.0), -m.growth) * c("debt_to_equity") * _over("current_ratio", 0.01)),
    Term("rollover_risk", "three_way", ("roa_volatility", "debt_ratio"),
         lambda m: c("roa_volatility") * c("debt_ratio") * m.rate),
    Term("pricing_power", "three_way", ("asset_turnover", "profit_margin"),
         lambda m: m.inflation * c("asset_turnover") * c("profit_margin")),
    Term("distress_signal", "three_way", ("stock_return_company", "debt_ratio"),
         lambda m: F.abs(clip("stock_return_company", upper=0.0)) * c("debt_ratio") * m.recession, stale=True),
]
THREE_WAY = [t.name for t in TERMS if t.family == "three_way"]
# terms of layer 1 that read columns of the panel, and the one that reads another term
INTERACTION_COLUMNS = [t.name for t in TERMS if t.family != "three_way" and t.name != "cash_rate_interaction"]


def layer_forms(names: Iterable[str], macro: Macro) -> dict[str, Column]:
    """The layer form of each named term, in registry order."""
    wanted = set(names)
    return {t.name: t.form(macro) for t in TERMS if t.name in wanted}


def shocked_forms(columns: Iterable[str], macro: Macro, mode: str) -> dict[str, Column]:
    """Every macro-dependent column of a scenario, among those whose inputs are
    there.  Mode ``reference`` leaves the stale ones and the recession part of
    the stress as they are; ``full`` evaluates all."""
    if mode not in ("reference", "full"):
        raise ValueError(f"unknown scenario mode {mode!r}")
    have, full = set(columns), mode == "full"
    out = {t.name: (t.shocked or t.form)(macro) for t in TERMS
           if not t.fixed and have.issuperset(t.needs) and (full or not t.stale)}
    zero, most = F.lit(0.0), F.lit(0.25)
    # each part of the stress: pressure over its scale, between 0 and a quarter
    stress = sum((F.least(most, F.greatest(zero, pressure) / scale)
                  for pressure, scale in ((macro.rate, 8), (-macro.growth, 20))),
                 F.least(most, F.greatest(zero, macro.inflation) / 10))
    if full:
        out["recession"] = macro.recession
        stress = stress + macro.recession * 0.25
    out["stress_intensity"] = stress * 100
    return out


@dataclass(frozen=True)
class Derived:
    """Family of a derived column and the variable it is made from."""
    family: str
    source: str | None = None


_DERIVED = {n: Derived("ratio") for n in RATIO_COLUMNS}
_DERIVED |= {f"{v}_lag{k}": Derived("lag", v) for v in LAG_VARIABLES for k in LAGS}
_DERIVED |= {f"{v}_rolling3": Derived("rolling", v) for v in ROLLING_VARIABLES}
_DERIVED |= {f"{v}_trend": Derived("trend", v) for v in ROLLING_VARIABLES}
_DERIVED |= {"roa_volatility": Derived("volatility", "roa")}
_DERIVED |= {t.name: Derived(t.family) for t in TERMS if t.name != "cash_ratio"}
_DERIVED |= {n: Derived("regime") for n in ("stagflation", "stress_intensity", "recession")}

_PRODUCT = re.compile(r"(?P<source>.+)_x_regime_\d+")
_DUMMY = re.compile(r"regime_\d+_dummy")


def describe(name: str) -> Derived | None:
    """The registry entry of a column; None when it is not derived."""
    if name in _DERIVED:
        return _DERIVED[name]
    if product := _PRODUCT.fullmatch(name):
        return Derived("regime_product", product["source"])
    if _DUMMY.fullmatch(name):
        return Derived("regime_dummy")
    if name.startswith("regime_"):
        return Derived("regime")
    return Derived("stress") if name.endswith("_stress") else None


def members(columns: Iterable[str], *families: str) -> list[str]:
    """The columns of the given families, in the order of ``columns``."""
    return [n for n in columns if (d := describe(n)) is not None and d.family in families]
