"""Reading, uniting and writing tables."""
