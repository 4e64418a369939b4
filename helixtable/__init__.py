"""A profile-versus-sequence search engine on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# functions go to the executors by value, so a cluster needs no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
