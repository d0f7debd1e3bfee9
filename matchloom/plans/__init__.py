"""Registered queries: the operators applied to bindings of the benchmark tables."""
