"""Operators for preparing text training data; nothing else in the library imports them."""
