"""Readers for the retail tables and writers for their results."""
