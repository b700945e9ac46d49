"""Operators that prepare texts and records for training data."""
