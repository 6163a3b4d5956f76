"""Column functions: angles, geometry, node names."""
