"""Operators over streams of pileup rows."""
