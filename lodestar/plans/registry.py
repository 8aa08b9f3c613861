"""All registered queries: importing the modules that hold them fills the registry."""

from lodestar.plans import more, search, vault  # noqa: F401
from lodestar.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
