"""Readers, writers and the document catalog."""
