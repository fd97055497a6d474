"""Operators of a training-data pipeline: filters, searches, de-duplication, counts and packing."""
