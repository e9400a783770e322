"""Full-text retrieval, term statistics and classification on Spark DataFrames."""

__version__ = "0.1.0"
