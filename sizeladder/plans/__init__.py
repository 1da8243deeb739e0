"""Whole flows built from operators."""
