"""paperlake: scholarly-literature retrieval and analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so that the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
