"""Sinks: reports as documents, annotations and state files."""
