"""Column functions: symbols, texts and numbers."""
