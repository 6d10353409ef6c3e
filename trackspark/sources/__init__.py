"""sources of trackspark."""
