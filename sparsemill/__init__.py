"""Sparse-feature analytics and online learning on Spark."""
