"""Operators that prepare notes as training text. Nothing outside this subpackage imports it."""
