"""Relational operators over objects, trees, commits and chunks."""
