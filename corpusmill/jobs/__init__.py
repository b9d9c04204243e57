"""Jobs of the library."""
