"""Operators for large-scale training-data preparation.

Self-contained: nothing outside this folder imports it, and it imports nothing
from the rest of the library.
"""
