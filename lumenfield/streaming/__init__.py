"""streaming of the cube engine."""
