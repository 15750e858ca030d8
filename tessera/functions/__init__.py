"""Column functions: vectors, bands and texts, grids, hashing."""
