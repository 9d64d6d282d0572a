"""Document and table retrieval as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The kernels travel to the Python workers with their tasks, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
