"""Functions of the factor engine."""
