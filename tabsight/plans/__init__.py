"""Composed analyses and the named-query catalogue (driver contract)."""
