"""Scoring, learning and model replacement over streams."""
