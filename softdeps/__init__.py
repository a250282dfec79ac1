"""Relaxed functional dependencies on Spark."""

import sys

from pyspark import cloudpickle

from softdeps.operators.cover import minimal_rfds
from softdeps.operators.pairs import distance_matrix, distance_vectors, row_pairs, value_distances
from softdeps.operators.skyline import skyline
from softdeps.operators.taxonomy import taxonomy_distance
from softdeps.operators.verify import rfd_check, rfd_holds, rfd_violations
from softdeps.plans.discover import combinations, discover_all, discover_from_vectors, discover_rfds
from softdeps.session import build_session, drop_staged

# Task functions travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "build_session",
    "combinations",
    "discover_all",
    "discover_from_vectors",
    "discover_rfds",
    "distance_matrix",
    "distance_vectors",
    "drop_staged",
    "minimal_rfds",
    "rfd_check",
    "rfd_holds",
    "rfd_violations",
    "row_pairs",
    "skyline",
    "taxonomy_distance",
    "value_distances",
]
