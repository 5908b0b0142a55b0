"""Readers, writers and views of the test tables."""
