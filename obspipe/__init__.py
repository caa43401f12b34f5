"""Product observations as Spark tables: capture, extraction, normalisation, validation, state."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, which then need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
