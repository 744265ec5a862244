"""Analytics over corpora of legacy word-processor documents, as PySpark plans."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to executors by value, so a cluster needs no installed copy of it.
register_pickle_by_value(sys.modules[__name__])
