"""threadloom: a PySpark-native engine over archived conversations.

Every operator maps DataFrames to DataFrames. Sub-packages: ``functions`` (column expressions), ``operators`` (batch
operators), ``streaming`` (Structured Streaming operators), ``sources`` (readers and writers), ``plans`` (registered
queries and their SQL).
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
