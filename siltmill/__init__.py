"""A search and session analytics engine expressed as Spark plans."""
