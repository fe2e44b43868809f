"""Catalogue, review and retrieval analytics as Spark DataFrame transformations."""
