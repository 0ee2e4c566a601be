"""Packet evidence engine: positioned text spans to adjudicated records, on Spark."""
