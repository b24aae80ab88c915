"""Bindings of the operators to the given tables, and the registered queries."""
