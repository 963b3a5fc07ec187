"""Operators for preparing training text at scale.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# task functions travel with the job, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
