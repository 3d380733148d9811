"""Registered queries: each module binds operators to the given tables."""
