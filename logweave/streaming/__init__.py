"""Continuous forms of some relations, for folders to which log files are added."""
