"""Relational operators over annotation tables."""
