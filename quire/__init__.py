"""Quire: document structuring and page-layout analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them, so a cluster does
# not need this package installed on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
