"""Relational building blocks of the reports."""
