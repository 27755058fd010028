"""pitloom - point-in-time features, ranking and monitoring as Spark DataFrame plans."""

__version__ = "0.1.0"
