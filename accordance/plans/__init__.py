"""Bindings of the given tables, and the registered queries."""
