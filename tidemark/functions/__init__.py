"""Byte-level functions as columns."""
