"""lakeseek: a Spark-native engine for document retrieval analytics."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: no executor needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
