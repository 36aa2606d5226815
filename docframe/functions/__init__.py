"""Values and their text forms."""
