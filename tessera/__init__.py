"""Versioned-table analytics on Spark."""
