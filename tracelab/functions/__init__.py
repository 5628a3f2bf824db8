"""Column functions: densities and small projections."""
