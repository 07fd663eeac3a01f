"""Operators that a training-data pipeline needs. Nothing else in the package imports this subpackage."""
