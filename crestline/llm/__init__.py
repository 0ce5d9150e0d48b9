"""Operators of a training-data pipeline: documents and pages in, DataFrames out."""
