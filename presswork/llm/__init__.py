"""Operators of a training-data pipeline: one module per operator, :mod:`.queries` registers them.

Functions that run inside tasks travel with the tasks by value, so the cluster
needs the third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
