"""Solvers as users hand them in: files with a function ``solve(cell)``."""
