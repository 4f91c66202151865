"""All registered queries over the relational operators, with the SQL that states each result."""

from spanloom.plans import annotate_queries, call_queries, cluster_queries, depth_queries, file_queries, read_queries, remap_queries, scoring_queries, sequence_queries  # noqa: F401
from spanloom.plans.registry import ORACLES, QUERIES  # noqa: F401
