"""Rare-variant association jobs on Spark.

Functions of this package that run inside Python tasks are sent along with the tasks, so executors need no
installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
