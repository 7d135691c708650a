"""Wearable-signal analytics as Spark DataFrame transformations."""
