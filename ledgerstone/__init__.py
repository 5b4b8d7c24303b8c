"""Ledger analytics on Spark: statements to transactions to monthly reports, as DataFrame plans."""

__version__ = "0.1.0"
