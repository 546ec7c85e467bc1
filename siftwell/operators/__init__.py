"""Relational building blocks of document search."""
