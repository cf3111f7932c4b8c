"""Frames as streams."""
