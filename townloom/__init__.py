"""townloom: district analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions used inside Arrow tasks travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
