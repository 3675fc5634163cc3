"""Relational operators over findings."""
