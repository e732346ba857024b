"""functions of the cube engine."""
