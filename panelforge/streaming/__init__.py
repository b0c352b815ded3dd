"""Streaming of the factor engine."""
