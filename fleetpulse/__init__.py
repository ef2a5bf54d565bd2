"""Host-metric analytics on Spark: features, anomaly scoring, forecasts, alerts, evaluation."""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions that run in tasks travel with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
