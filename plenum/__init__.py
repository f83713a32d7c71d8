"""Plenum: a Spark-native engine for indoor-scene analytics, transcript analytics and corpus pipelines."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code with them, so that it needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
