"""operators of the cube engine."""
