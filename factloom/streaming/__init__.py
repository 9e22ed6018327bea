"""Facts as streams."""
