"""Composed plans: the inspection rules."""
