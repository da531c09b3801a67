"""Operators for preparing training text.

The package stands alone: the rest of the library does not import it.
"""
