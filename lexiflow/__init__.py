"""lexiflow: a PySpark-native text-analytics engine.

Python functions of this package travel to the executors by value, so that a
cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
