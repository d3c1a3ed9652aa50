"""Storing indexes: Parquet bundles and JSON."""
