"""Every operator as a query over the given tables, with its check in SQL."""

from vesselflow.registry.base import Context, Query, all_queries

__all__ = ["Context", "Query", "all_queries"]
