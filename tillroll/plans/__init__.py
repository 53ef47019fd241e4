"""Analytical jobs over the canonical shop tables."""
