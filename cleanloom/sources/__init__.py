"""Readers (CSV, JSON, workbooks, parquet) and writers."""
