"""Relationship analytics on Spark."""
