"""Schema planning and the query catalogue."""
