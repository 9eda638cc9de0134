"""Operators on DataFrames: history of a key, ordered folds, lookups, events and statistics."""
