"""Declarative cleaning plans and the end-to-end pipeline."""
