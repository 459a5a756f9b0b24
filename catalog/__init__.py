"""The registered queries and their SQL counterparts."""

from catalog.spark_queries import QUERIES, flagship
from catalog.sql import ORACLE

__all__ = ["ORACLE", "QUERIES", "flagship"]
