"""Readers: parquet tables, HTML archives, change feeds, question sets."""
