"""Corpus operators over DataFrames."""
