"""Sources of the factor engine."""
