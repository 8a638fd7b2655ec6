"""marketloom: market-series features and news analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Arrow functions of this package travel to the executors by value, so a cluster needs no
# copy of the package installed on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
