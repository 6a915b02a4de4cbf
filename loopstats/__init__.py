"""Quality-loop analytics on Spark DataFrames: every operator takes and returns DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so that executors need no
# installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
