"""Whole plans: building an index, serving it, the command line."""
