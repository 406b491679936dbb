"""Registered queries of the core operators, by area."""
