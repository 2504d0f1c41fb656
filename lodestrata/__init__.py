"""lodestrata: Spark-first analytics over call graphs and evidence graphs."""

__version__ = "0.1.0"
