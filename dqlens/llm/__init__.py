"""Operators of a training-data pipeline: filtering, joining, mixing, packing and formatting of texts.

Functions that run on executors travel with the job by value, so a cluster needs no
installed copy of this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
