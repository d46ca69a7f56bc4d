"""Readers and writers: volumes, manifests, file listings, result tables."""
