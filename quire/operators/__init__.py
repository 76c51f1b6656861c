"""Operators: DataFrame -> DataFrame transformations (see README inventory)."""
