"""Validation, profiling, checks, fixes, recommendations, outliers and impact."""
