"""Readers and the shared folder."""
