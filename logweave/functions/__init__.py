"""Column functions: JSON, text and time semantics that session logs need."""
