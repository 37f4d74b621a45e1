"""Column-level building blocks: text, vector and statistics expressions."""
