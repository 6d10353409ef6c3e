"""plans of trackspark."""
