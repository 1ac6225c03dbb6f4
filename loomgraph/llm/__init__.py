"""Operators for training-data work. Nothing outside this subpackage imports it."""
