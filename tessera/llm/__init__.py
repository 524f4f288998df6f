"""Operators of a training-data pipeline over a ``documents`` table, one module each.

Nothing else in the package imports this subpackage."""
