"""Structured Streaming jobs; every operator here also runs on a batch DataFrame."""
