"""Schemas, samples and documents: what a mapping is made from."""
