"""Journals, JSON stores, blobs, documents and pages as DataFrames, and their sinks."""
