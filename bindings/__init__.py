"""Binding of the library's operators to the shared test tables: relations, query registry, oracle SQL."""
