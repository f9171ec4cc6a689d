"""plans of the closura engine."""
