"""Incremental analytics and vector engine on PySpark."""
