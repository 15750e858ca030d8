"""Readers, writers and configuration frames."""
