"""Spark operators for evaluating text-to-SQL systems at scale."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks that call them: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
