"""Column expressions: dates, numbers, labels, text and test distributions."""
