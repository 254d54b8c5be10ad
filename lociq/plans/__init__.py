"""The queries over the driver's tables; importing the modules registers them."""

from lociq.plans import collection, history, catalog, files, values, more  # noqa: I001
from lociq.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "collection", "files", "history", "more", "values"]
