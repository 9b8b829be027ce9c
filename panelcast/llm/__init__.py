"""Operators on large text corpora and embedding tables; nothing else in the library imports them."""
