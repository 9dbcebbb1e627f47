"""Readers and writers: tab-separated files, parquet tables, reports."""
