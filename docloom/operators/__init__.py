"""Relational operators over document graphs."""
