"""Column expressions over names, paths, texts and numbers."""
