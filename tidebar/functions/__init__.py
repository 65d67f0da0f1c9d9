"""Column functions: price lines, stops, ratios, text."""
