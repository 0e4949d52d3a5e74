"""seedloom: genome-scale interval, signal, corpus and metric jobs as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Row helpers travel with the task, so Python workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
