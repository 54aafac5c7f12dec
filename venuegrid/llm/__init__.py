"""Operators for training-data pipelines: filtering, joins, scoring, packing, output."""
