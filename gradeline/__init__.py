"""Judging document-extraction and page-layout systems with Spark DataFrames."""
