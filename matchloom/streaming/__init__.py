"""Continuous forms of the catalog and job operators on Structured Streaming."""
