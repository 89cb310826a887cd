"""Every registered query, one module per field."""

from spanledger.catalog import episode_queries, export_queries, model_queries, sparse_queries, table_queries  # noqa: F401
from spanledger.catalog.registry import REGISTRY, Query, query  # noqa: F401
