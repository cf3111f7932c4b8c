"""Column expressions and plain-Python values: geometry, colors, text, vectors and configuration."""
