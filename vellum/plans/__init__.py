"""Whole jobs, network specifications and the registered queries."""
