"""Operators of a training-data pipeline: filters, searches, joins, packing, sharding and scoring."""
