"""Operators for building training corpora: sharding, selection, mixing, deduplication, scans and word statistics.

Nothing outside this folder imports it, save ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package: its helpers travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
