"""Structured Streaming forms of the sequential test and of log ingestion."""
