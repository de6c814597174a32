"""Classifier distillation on Spark: teacher labels in, a small text student out.

Every operator is a ``DataFrame -> DataFrame`` function. Nothing here collects
row data; only results whose size is fixed by the task (at most 32 labels, 12
regulariser candidates, one ``labels x dimensions`` weight table) reach the
driver.
"""

import sys

from pyspark import cloudpickle

# Ship our Arrow helpers by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
