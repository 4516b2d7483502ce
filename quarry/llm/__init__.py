"""Training-data operators: scoring, near-duplicates, decontamination, mixing and sharding of
document tables. Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# task functions travel with the job: executors need no copy of the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
