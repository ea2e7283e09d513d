"""Detection-event analytics on Spark: policies, trigger gates, timelines and logs for fleets of traps."""

import sys

from pyspark import cloudpickle

# Code that runs in tasks travels with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
