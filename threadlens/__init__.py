"""threadlens: Spark jobs over archives of discussion sites."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from threadlens.session import get_session, prepare  # noqa: E402

__all__ = ["get_session", "prepare"]
