"""closura: budget-constrained structural retrieval over symbol graphs, and training-data operators, on Spark."""

__version__ = "0.1.0"
