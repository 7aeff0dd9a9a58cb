"""Finds inconsistencies in collections of stories with Spark."""
