"""Column functions: text, scores, URLs, labels, chapter blocks."""
