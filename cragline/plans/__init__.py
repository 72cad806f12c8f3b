"""Bindings to tables, experiment plans and registered queries."""
