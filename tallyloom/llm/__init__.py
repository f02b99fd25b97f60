"""Operators for the text side of a training-data pipeline. Nothing else in the library imports this package."""
