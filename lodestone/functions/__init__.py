"""Column functions and small algorithms on text, lines and ids."""
