"""Change feeds and live queries."""
