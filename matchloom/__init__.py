"""Point-in-time match forecasting and evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
