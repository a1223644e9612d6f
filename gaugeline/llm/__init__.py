"""Operators that turn a raw text corpus into training data; nothing else in the library imports them."""
