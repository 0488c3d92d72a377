"""Operators that prepare text corpora and link records; nothing else in the library imports them."""
