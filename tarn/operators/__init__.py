"""Operators on lattices, lines, lakes and trees, as DataFrame plans."""
