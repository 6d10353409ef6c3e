"""operators of trackspark."""
