"""Operators of the factor engine."""
