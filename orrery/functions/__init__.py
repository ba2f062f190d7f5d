"""Column functions: geometry, vocabulary and palettes."""
