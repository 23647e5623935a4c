"""Relational, graph and review operators (DataFrame -> DataFrame)."""
