"""functions of trackspark."""
