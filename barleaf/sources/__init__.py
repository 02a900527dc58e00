"""Readers, writers and generators of panel tables."""
