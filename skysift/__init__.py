"""Aerial inspection analytics as Spark DataFrame operators."""
