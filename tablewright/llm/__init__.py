"""Operators that prepare text corpora for training. Nothing else in the library imports this subpackage.

Functions defined here travel to the workers by value, so a cluster needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
