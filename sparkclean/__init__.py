"""Clean tables of any size on Spark, and prove that the cleaning was right."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to the executors inside the task, so a cluster needs no
# copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
