"""sedgeway: grounded question answering and corpus processing as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
