"""Row-local cleaning of streams."""
