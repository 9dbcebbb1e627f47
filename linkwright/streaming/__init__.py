"""Incremental reading of source files."""
