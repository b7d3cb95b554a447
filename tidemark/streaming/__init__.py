"""Structured Streaming into tables and over logs."""
