"""Crawl-data jobs on Spark: links, frontier, robots rules, politeness, archives."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers with their code, so executors
# need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
