"""Bindings of operators to the given tables, with their SQL counterparts."""
