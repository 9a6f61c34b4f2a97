"""Frequent-subgraph mining and corpus preparation on PySpark."""
