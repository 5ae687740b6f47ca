"""Structured Streaming forms of assembly and counting."""
