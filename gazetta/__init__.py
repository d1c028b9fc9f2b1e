"""Regulatory-document analytics as Spark DataFrame transformations."""
