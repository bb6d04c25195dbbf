"""Readers, change normalisers and writers."""
