"""Projections of the benchmark tables and the registered queries."""
