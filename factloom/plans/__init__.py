"""Whole plans built from the operators."""
