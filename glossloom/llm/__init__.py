"""Operators for training-data pipelines: token counts, mixing, classifiers, fingerprints, near duplicates, packing.

Nothing outside this subpackage imports it.
"""
