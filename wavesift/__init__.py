"""Sequence summarisation and training-data operators on PySpark."""
