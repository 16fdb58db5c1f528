"""Operators from DataFrame to DataFrame: transforms, features, scoring, learning, metrics, weight tables."""
