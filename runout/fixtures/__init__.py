"""Extracts for the registered queries, derived from the order tables."""
