"""operators of the closura engine."""
