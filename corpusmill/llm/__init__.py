"""Operators for preparing large training-data collections (clusters, neighbours, duplicates, leaks, mixes, cuts)."""
