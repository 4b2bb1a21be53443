"""Operators for preparing training and evaluation data; nothing else in the library imports this package."""
