"""Fixtures of the parent folder apply."""
