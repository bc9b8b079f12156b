"""Review retrieval and listing analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster runs them
# without the package being installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
