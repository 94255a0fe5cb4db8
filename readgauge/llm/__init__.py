"""Training-data operators. Nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the workers by value, so that only the driver needs the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
