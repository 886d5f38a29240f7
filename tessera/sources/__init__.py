"""Readers: members of ZIP archives as lines, delimited and fixed-width records, JSON tables."""
