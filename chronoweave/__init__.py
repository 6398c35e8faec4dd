"""Time-aware knowledge analytics on Spark: an event log, bi-temporal facts, beliefs, episodes, graph and retrieval."""

__version__ = "0.1.0"
