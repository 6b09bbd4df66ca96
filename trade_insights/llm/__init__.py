"""Operators of large training-data pipelines, and their registered queries."""
