"""pagemill: landed product-page crawls in, clean item tables out, on Spark."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their code, so the executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
