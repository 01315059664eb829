"""Operators that prepare claim text and records for language models. Nothing else in the library imports this package."""
