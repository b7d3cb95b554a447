"""Stateful operators: batches, tables and cursors."""
