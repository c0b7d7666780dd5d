"""Queries over the driver's tables, and SQL with the same results."""
