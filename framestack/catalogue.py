"""All registered queries of the library, without those of the corpus operators."""

from .plans import block_queries, cohort_queries, gate_queries, grid_queries, match_queries, mosaic_queries, night_queries, photometry_queries, rule_queries, scalar_queries, source_queries, stack_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES  # noqa: F401
