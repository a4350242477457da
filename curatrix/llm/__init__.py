"""Training-data pipeline operators. Nothing else in the library imports this subpackage.

Functions of this subpackage that run in Spark's Python workers are sent by value,
so a cluster's workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
