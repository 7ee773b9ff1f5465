"""Mapping documents compiled to DataFrame expressions."""
