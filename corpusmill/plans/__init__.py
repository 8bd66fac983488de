"""Whole flows made of operators, and the registered queries."""
