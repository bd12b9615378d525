"""tessera: a library of DataFrame-first analytics operators on PySpark.

Families: relational workloads, graph analytics, machine learning, event
streams, and a total-sort benchmark.  Every operator takes DataFrames and
returns a DataFrame; see ``tessera.plans.catalog`` for the registered
queries and their SQL oracles.
"""

import sys as _sys

__version__ = "0.1.0"

# Functions and classes of this package that run inside tasks (mapInPandas
# bodies, the Python data source) are shipped by value, so executors need
# no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
