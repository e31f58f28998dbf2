"""Column expressions: numbers out of dirty text, infinities, labels, stable draws."""
