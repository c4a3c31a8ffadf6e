"""lexigraph: a PySpark-native engine for topic graphs over large text collections.

Operators are plain functions ``(DataFrame..., params) -> DataFrame``.  Everything that can be a logical plan is one;
Python runs only inside Arrow kernels.
"""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
