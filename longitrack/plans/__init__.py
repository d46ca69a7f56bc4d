"""Pipelines assembled from the operators, and the query catalogue."""
