"""Operators for preparing large text corpora. Nothing else in catalograph imports this package."""
