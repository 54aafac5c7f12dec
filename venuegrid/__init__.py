"""Place analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel with the plan, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
