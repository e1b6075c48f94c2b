"""sitequarry: a PySpark-native engine for web-site audits and the tables behind them.

Every operator is a function from DataFrames to a DataFrame.  Nothing here needs
to be installed on the executors: the package registers itself to be pickled by
value, so Python kernels travel with the plan.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
