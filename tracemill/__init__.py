"""Analytics over coding-agent sessions, and the operators of a training-data pipeline, as Spark jobs."""

import sys

from pyspark import cloudpickle

# What runs inside tasks travels by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
