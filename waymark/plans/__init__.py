"""All registered queries."""

from . import golden, reports  # noqa: F401  register their queries
from .catalog import CATALOG, Query

__all__ = ["CATALOG", "Query"]
