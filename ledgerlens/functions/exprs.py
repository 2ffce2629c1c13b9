"""Null-safe scalar expression helpers (all JVM-side, codegen friendly).

Spark keeps NULL and NaN apart and raises on division by zero in ANSI mode;
the panel semantics want "undefined -> NULL" everywhere, so every ratio goes
through ``safe_div`` and every clip keeps NULL as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or either side is NULL (never inf/NaN)."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def clip(x, lower=None, upper=None) -> Column:
    """pandas ``clip``: NULL stays NULL (``least``/``greatest`` skip NULLs)."""
    x = _c(x)
    out = x
    if lower is not None:
        out = F.greatest(out, _c(lower))
    if upper is not None:
        out = F.least(out, _c(upper))
    return F.when(x.isNotNull(), out)


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int, a NULL comparison gives 0 (pandas ``astype(int)``)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def null_if_nonfinite(x) -> Column:
    """Ingest guard: NaN and +-inf become NULL."""
    x = _c(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """``select_dtypes(include=number)`` on the schema."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]
