"""Media-traffic analytics on Spark: request logs, pages, manifests, fetch logs and timelines as DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get the few functions they run by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
