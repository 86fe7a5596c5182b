"""Readers and writers for the text formats and the Parquet layout."""
