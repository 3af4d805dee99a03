"""Declarative rule tables."""
