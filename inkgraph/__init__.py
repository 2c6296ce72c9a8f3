"""Documentation-graph analytics and corpus preparation, expressed as Spark DataFrame operators."""

__version__ = "0.1.0"
