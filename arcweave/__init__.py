"""Geometric knowledge-graph analytics on PySpark."""
