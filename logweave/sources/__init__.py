"""Readers of session logs and of the stores beside them."""
