"""Event-stream SQL on Spark: the registered queries."""

from weir.plans import catalog, functions, sinks, streams, tables
from weir.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "functions", "sinks", "streams", "tables"]
