"""Reading inputs and writing tables."""
