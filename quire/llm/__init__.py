"""Operators for training-data pipelines: sentence units, alignment, defects, mixing, packing, subjects."""
