"""Leakage-safe dataset preparation as PySpark DataFrame operators."""
