"""Profiling, matching, review, verification and metrics over DataFrames."""
