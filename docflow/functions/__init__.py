"""Column functions: text, numbers, dates and URLs."""
