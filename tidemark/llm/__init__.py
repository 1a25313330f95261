"""Operators for preparing training data: every one takes and returns DataFrames."""
