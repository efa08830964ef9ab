"""Operators on DataFrames. Row counts of results equal those of inputs unless stated."""
