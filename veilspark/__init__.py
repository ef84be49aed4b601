"""veilspark: finding and removing sensitive data with Spark DataFrames."""

__version__ = "0.1.0"
