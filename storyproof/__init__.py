"""Narrative-evidence analytics as Spark DataFrame transformations."""
