"""Operators of a training-data pipeline over web-scale corpora. Nothing else in the library imports this package."""
