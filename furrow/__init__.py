"""furrow: a PySpark engine for daily market-price series."""

import sys

from pyspark import cloudpickle

# task functions travel by value: executors need pandas and numpy, not furrow
cloudpickle.register_pickle_by_value(sys.modules[__name__])
