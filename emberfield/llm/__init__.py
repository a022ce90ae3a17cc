"""Operators for preparing training text: joins, classifiers, packing, search, scoring."""
