"""The operators on tables and texts."""
