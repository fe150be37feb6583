"""Recommendation queries built from the operators, and the facade over them."""
