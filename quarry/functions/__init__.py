"""Subpackage of quarry."""
