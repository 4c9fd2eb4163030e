"""A Spark-first analytics library for account-book style records."""

__version__ = "0.1.0"
