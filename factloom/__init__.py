"""PySpark operators over text and code corpora."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel whole, so that workers need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
