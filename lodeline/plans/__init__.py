"""Model views over the given tables and the registered queries."""

from lodeline.plans import (  # noqa: F401
    catalogue_queries,
    graph_queries,
    index_queries,
    log_queries,
    patch_queries,
    policy_queries,
    registry_queries,
    search_queries,
    stream_queries,
    structure_queries,
    text_queries,
)
from lodeline.plans.registered import ORACLES, QUERIES  # noqa: F401
