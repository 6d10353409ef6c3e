"""streaming of trackspark."""
