"""Readers, writers, tables and snapshots."""
