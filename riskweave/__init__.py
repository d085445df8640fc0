"""riskweave — Spark-native text-risk analytics (sentences, topics, uniqueness, rankings).

Python functions that run inside tasks (the few Arrow UDFs and grouped-map steps) are shipped
to executors by value, so workers need no copy of this package on their path.
"""

import sys as _sys

try:  # PySpark's bundled cloudpickle
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without by-value support
    pass
