"""Readers and writers: logs, artifacts, and the mapping of general tables to flows."""
