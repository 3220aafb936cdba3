"""Revision ledger analytics on PySpark."""
