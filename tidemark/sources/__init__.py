"""Reading and writing tables and texts."""
