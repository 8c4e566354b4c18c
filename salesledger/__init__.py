"""Sales cleaning and reporting, and an expense ledger, as Spark DataFrame
operators."""

__version__ = "0.1.0"
