"""Column expressions: text, geometry, text analysis and request checks."""
