"""Distributed data preparation on Spark: diagnose, clean, fill, scale, profile tables and texts.

Every operator takes a ``DataFrame`` and returns a ``DataFrame``.  Model-like steps are split in a
``fit_*`` (a fixed number of aggregations whose result is a few numbers per column) and an
``apply_*`` (a row-local projection), so the apply half also runs on a stream.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
