"""Readers and writers, model files, and adapters from relational tables to model outputs."""
