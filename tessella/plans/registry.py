"""Query name to callable and to the equal SQL, over the reference's own operators."""

from __future__ import annotations

from . import annotation_queries, dataset_queries, whole_queries

QUERIES: dict = {**annotation_queries.QUERIES, **dataset_queries.QUERIES, **whole_queries.QUERIES}
ORACLES: dict = {**annotation_queries.ORACLES, **dataset_queries.ORACLES, **whole_queries.ORACLES}
