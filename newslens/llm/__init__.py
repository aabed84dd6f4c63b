"""Operators for preparing training text at scale, and their queries."""
