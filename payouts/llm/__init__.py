"""Operators for training-data pipelines, their named queries and the SQL counterparts."""
