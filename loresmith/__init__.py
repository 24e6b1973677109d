"""loresmith: retrieval and knowledge-base analytics as Spark DataFrame transformations."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few functions that run in Python workers travel with the job, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
