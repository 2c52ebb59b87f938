"""Readers, writers and generated frames."""
