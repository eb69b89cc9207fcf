"""DataFrame-to-DataFrame operators for market and trading data on Spark."""

__version__ = "0.1.0"
