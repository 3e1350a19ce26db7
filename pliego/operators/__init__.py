"""Relational operators that plans are composed of."""
