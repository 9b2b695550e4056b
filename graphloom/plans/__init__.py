"""Graphs derived from relational tables, and the registered queries over them."""
