"""Tessera: document curation, retrieval, fact extraction and rule decisions as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to executors by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
