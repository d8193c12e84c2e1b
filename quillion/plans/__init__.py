"""Query text handling and the query catalogue."""
