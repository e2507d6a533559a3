"""Operators for corpora of training text; nothing else in the library imports this subpackage."""
