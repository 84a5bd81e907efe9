"""Operators for large training corpora and for matching by learned evidence."""
