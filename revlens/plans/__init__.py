"""Queries that put the operators to the driver's tables, and their SQL."""
