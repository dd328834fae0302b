"""Trajectory analytics and corpus processing on PySpark."""
