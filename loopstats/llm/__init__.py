"""Operators for preparing language-model training text, each over whole tables."""
