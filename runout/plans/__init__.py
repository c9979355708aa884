"""Composition of the operators into the planning run, and the registered queries."""
