"""Readers, writers and the built-in taxonomy."""
