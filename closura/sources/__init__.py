"""sources of the closura engine."""
