"""Vector and keyword search analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Kernels and data sources travel to the executors by value, so a cluster needs no copy of
# this package on its workers' Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
