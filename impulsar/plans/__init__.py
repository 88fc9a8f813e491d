"""Specifications: settings, terms, and the SQL of the same estimates."""
