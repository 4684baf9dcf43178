"""peerpanel: compare many count time series with their peers on Spark.

The grouped pandas functions (LOWESS smoother, Bayesian model) are
defined in this package; it is registered for pickle-by-value so that
executors do not need the package installed.
"""

import sys as _sys

try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark
    pass
