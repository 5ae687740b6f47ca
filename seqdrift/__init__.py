"""Profiles of large populations of ordered event sequences, and how far two populations differ."""
