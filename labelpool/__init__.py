"""labelpool: choose which rows of a large unlabeled table to label next, on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so that the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
