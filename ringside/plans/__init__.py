"""Whole analyses: chains of operators, and the registered queries."""
