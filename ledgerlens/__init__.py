"""ledgerlens: company x year panel risk analytics on Spark DataFrames.

Layers (all DataFrame in, DataFrame out):

* ``sources``   panel scans, fixture panels built from the driver tables, sinks
* ``functions`` column-expression helpers, exact distributed medians/quantiles,
                the feature registry
* ``operators`` profiling, cleaning, features, regimes, models, attribution,
                scenarios, risk tables
* ``plans``     end-to-end layer flows and the query catalogue
* ``streaming`` (the analysed workload has no streaming part; see its docstring)
"""

__version__ = "0.1.0"
