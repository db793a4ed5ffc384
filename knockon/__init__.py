"""knockon: carry-over analytics for entity-chained event sequences on Spark."""

__version__ = "0.1.0"
