"""tessera: DataFrame-in / DataFrame-out operators for text-scoring data work on Spark."""

__version__ = "0.1.0"
