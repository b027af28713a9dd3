"""The statement language: text to plain data."""

from .parser import parse, split_statements

__all__ = ["parse", "split_statements"]
