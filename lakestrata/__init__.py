"""Layered-table operators for PySpark: DataFrames in, DataFrames out."""
