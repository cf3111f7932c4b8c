"""Spark analytics for the output of vision models."""
