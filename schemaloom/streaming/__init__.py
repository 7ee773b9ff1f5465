"""Mappings on streams."""
