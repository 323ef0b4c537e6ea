"""Operators that prepare training text: nothing outside this package imports it."""
