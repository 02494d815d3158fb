"""A Spark-first engine for genome similarity, and the data operators around it."""

import sys

from pyspark import cloudpickle

# kernels travel to the executors with their code: a cluster needs no installation of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
