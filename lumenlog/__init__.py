"""Lumenlog: Spark-first mining and scoring of behaviour patterns in event logs."""

__version__ = "0.1.0"
