"""Tabular profiling, feature engineering, model quality and drift as Spark jobs.

Functions that run on workers travel by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"
cloudpickle.register_pickle_by_value(sys.modules[__name__])
