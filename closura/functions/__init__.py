"""functions of the closura engine."""
