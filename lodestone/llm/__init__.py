"""Operators for large training-text corpora; nothing outside this subpackage imports it."""
