"""Layout-annotation and symbolic-score analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions travel inside the plan, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
