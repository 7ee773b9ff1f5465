"""Column functions that keep the number, date and equality rules of the mapping language."""
