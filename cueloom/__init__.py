"""Spark jobs for timed transcripts, subtitles and text corpora.

Python helpers that run inside tasks are shipped by value, so executors need
no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
