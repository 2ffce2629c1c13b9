"""Column helpers and exact distributed statistics."""

from .exprs import (safe_div, clip, flag, null_if_nonfinite,
                    numeric_columns)
from .stats import (median_by, hot_median_by, hot_quantiles_by, fill_with_medians, percentiles,
                    pair_corr)

__all__ = ["safe_div", "clip", "flag", "null_if_nonfinite", 
           "numeric_columns", "median_by", "hot_median_by", "hot_quantiles_by",
           "fill_with_medians", "percentiles", "pair_corr"]
