"""Operators for preparing training text: nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# The functions that run inside tasks travel with the task, so that workers need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
