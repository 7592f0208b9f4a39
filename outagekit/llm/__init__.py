"""Operators of a training-data pipeline, one module per operator.

The functions that run in tasks travel with them (pickled by value), so
executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
