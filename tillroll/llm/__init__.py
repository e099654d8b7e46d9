"""Operators for preparing training data, each with its query (see registry)."""
