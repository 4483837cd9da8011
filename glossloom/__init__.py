"""Spark jobs for building and analysing small, labelled time-series corpora."""
