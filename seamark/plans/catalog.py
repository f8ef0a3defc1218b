"""All registered queries, by importing the modules that register them."""

from seamark.plans import embedding, ingest, lifecycle, metering, preparation, search, stores  # noqa: F401
from seamark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
