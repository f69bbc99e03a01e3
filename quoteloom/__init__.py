"""Batch and incremental jobs over stock price history, accounts and reports, for PySpark.

Every job takes and returns DataFrames; none makes a session.  Times of record are arguments (``as_of``)."""
