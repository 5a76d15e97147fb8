"""Whole plans: the resolver pipeline and the registered queries."""
