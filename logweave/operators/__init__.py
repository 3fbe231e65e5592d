"""Operators on entries: every one is a DataFrame -> DataFrame function over any number of sessions."""
