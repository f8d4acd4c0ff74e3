"""Profiling of JSON document collections and cardinality estimation, as DataFrame programs."""
