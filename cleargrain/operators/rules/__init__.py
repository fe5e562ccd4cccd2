"""Data-quality rules: a registry of families and the facts they need."""
