"""Bindings of the operators to concrete tables, registered queries and the full run."""
