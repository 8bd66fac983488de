"""Column functions: text, dates, vectors, scores."""
