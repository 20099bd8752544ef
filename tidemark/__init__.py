"""Behaviour analytics and recommendations over an event table, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from tidemark.session import AS_OF, build_session

# The small functions that run inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["AS_OF", "build_session"]
