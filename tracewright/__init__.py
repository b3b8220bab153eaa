"""tracewright: provenance-graph analytics and event-log preparation on Spark DataFrames."""

__version__ = "0.1.0"
