"""Operators of a training-data pipeline, one module each; nothing else in the library imports them.

Their functions travel to the executors by value, so the executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
