"""Scans, checks and sinks of the corpus."""
