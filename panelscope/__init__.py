"""Panel analytics on Spark: operators over one long table keyed by entity and time.

Functions that run inside Spark tasks are pickled by value, so executors need
no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
