"""Scalar functions: hashing, masks, losses."""
