"""Whole runs: operators wired together with their stage tables."""
