"""What the driver's entry registers."""

from presswork.plans import catalog_literals, catalog_management  # noqa: F401 - they register their queries
from presswork.plans.catalog import ORACLES, QUERIES, daily_report

__all__ = ["ORACLES", "QUERIES", "daily_report"]
