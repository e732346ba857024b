"""sources of the cube engine."""
