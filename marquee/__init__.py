"""Batch recommendation and review analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions carry their helpers with them: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
