"""Operators composed into whole jobs."""
