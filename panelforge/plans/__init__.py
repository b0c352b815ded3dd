"""Plans of the factor engine."""
